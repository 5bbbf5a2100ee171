"""Check-side SQL of the derived tables, as CTE bodies."""

RAW_TRACES = """
SELECT
  'tr_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
  'grp-' || CAST(user_id AS VARCHAR) AS trace_group_id,
  'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id,
  'ws-' || CAST(user_id % 5 AS VARCHAR) AS workspace_id,
  ts AS timestamp,
  CASE k % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'llm' END AS provider,
  CASE k % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END
             WHEN 1 THEN CASE k % 4 WHEN 0 THEN 'claude-opus-4-1' WHEN 1 THEN 'claude-sonnet-4-20250514'
                                    WHEN 2 THEN 'claude-3-opus-20240229' ELSE 'Claude-3-Haiku-20240307' END
             ELSE 'local-model' END AS model,
  CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS request_method,
  CASE k % 3 WHEN 0 THEN '/openai/v1/chat/completions' WHEN 1 THEN '/anthropic/v1/messages'
             ELSE CASE WHEN k % 5 = 0 THEN '/llmish/v1/responses' WHEN k % 5 = 1 THEN '/llm'
                       ELSE '/llm/v1/responses' END END AS request_path,
  CASE WHEN event_type <> 'error' THEN 200
       ELSE CASE k % 4 WHEN 0 THEN 400 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 502 END END AS response_status,
  CAST(floor(value * 10) AS INT) AS input_tokens,
  k * 3 AS output_tokens,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(value * 10) AS INT) + k * 3 END AS total_tokens,
  CAST(floor(value * 7) AS BIGINT) + k AS latency_ms,
  CASE WHEN event_id % 4 = 1 THEN CAST(floor(value) AS BIGINT) + 1 ELSE CAST(0 AS BIGINT) END AS time_to_first_token_ms,
  CASE WHEN event_id % 4 = 2 THEN CAST(floor(value * 1000) AS BIGINT) + 1 ELSE CAST(0 AS BIGINT) END AS time_to_first_token_us,
  CASE WHEN user_id % 7 = 6 THEN '' ELSE 'kh-' || CAST(user_id % 50 AS VARCHAR) END AS api_key_hash,
  '{"streaming":' || CASE WHEN event_id % 4 IN (1, 2) THEN 'true' ELSE 'false' END
    || ',"access_key_id":"gk-' || CAST(user_id AS VARCHAR) || '"'
    || ',"lineage_thread_id":"th-' || CAST(user_id AS VARCHAR) || '"'
    || ',"lineage_run_id":"run-' || CAST(event_id % 2 AS VARCHAR) || '"'
    || CASE WHEN event_id % 3 = 0 THEN ',"lineage_checkpoint_seq":' || CAST(event_id % 11 AS VARCHAR) ELSE '' END
    || '}' AS metadata,
  ts + (event_id % 7) * INTERVAL '1' SECOND AS created_at
FROM (SELECT e.*, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k FROM events e) t
"""

PRICES = """
SELECT * FROM (VALUES
  ('openai', 0, true, 'gpt-4o', 0.005::DOUBLE, 0.015::DOUBLE),
  ('openai', 1, true, 'gpt-4o-mini', 0.00015, 0.0006),
  ('anthropic', 2, true, 'claude-opus-4-1', 0.015, 0.075),
  ('anthropic', 3, true, 'claude-sonnet-4-20250514', 0.003, 0.015),
  ('anthropic', 4, false, 'claude-opus-4-', 0.015, 0.075),
  ('anthropic', 5, false, 'claude-3-opus-', 0.015, 0.075),
  ('anthropic', 6, false, 'claude-3-haiku-', 0.00025, 0.00125)
) AS p(provider, pos, exact, pattern, input_per_1k, output_per_1k)
"""

TRACES = """
SELECT r.* REPLACE (
    CASE WHEN total_tokens = 0 THEN input_tokens + output_tokens ELSE total_tokens END AS total_tokens,
    CASE WHEN time_to_first_token_ms = 0 AND time_to_first_token_us > 0
         THEN (time_to_first_token_us + 999) // 1000 ELSE time_to_first_token_ms END AS time_to_first_token_ms,
    CASE WHEN time_to_first_token_us = 0 AND time_to_first_token_ms > 0
         THEN time_to_first_token_ms * 1000 ELSE time_to_first_token_us END AS time_to_first_token_us),
  json_extract_string(metadata, '$.access_key_id') AS access_key_id,
  input_tokens / 1000.0::DOUBLE * rate_in + output_tokens / 1000.0::DOUBLE * rate_out AS estimated_cost_usd
FROM (SELECT *,
   CASE WHEN model = 'gpt-4o' THEN 0.005::DOUBLE WHEN model = 'gpt-4o-mini' THEN 0.00015 WHEN model = 'claude-sonnet-4-20250514' THEN 0.003
        WHEN model = 'Claude-3-Haiku-20240307' THEN 0.00025 WHEN provider = 'anthropic' THEN 0.015 ELSE 0 END AS rate_in,
   CASE WHEN model = 'gpt-4o' THEN 0.015::DOUBLE WHEN model = 'gpt-4o-mini' THEN 0.0006 WHEN model = 'claude-sonnet-4-20250514' THEN 0.015
        WHEN model = 'Claude-3-Haiku-20240307' THEN 0.00125 WHEN provider = 'anthropic' THEN 0.075 ELSE 0 END AS rate_out
  FROM raw_traces) r
"""

ACCESS_KEYS = """
SELECT 'gk-' || CAST(user_id AS VARCHAR) AS id,
  'th-' || CAST(user_id AS VARCHAR) AS token_hash,
  'org-' || CAST(user_id % 3 AS VARCHAR) AS org_id,
  'ws-' || CAST(user_id % 5 AS VARCHAR) AS workspace_id,
  CASE user_id % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'developer' WHEN 2 THEN 'viewer' ELSE 'custom' END AS role,
  CASE WHEN user_id % 4 = 3 THEN 'Analytics:Read' ELSE '' END AS extra_permission,
  min(ts) AS created_at,
  CASE WHEN user_id % 9 = 8 THEN max(ts) END AS revoked_at
FROM events GROUP BY user_id
"""

WS_MESSAGES = """
SELECT 'conn-' || CAST(user_id AS VARCHAR) AS connection_id, event_id AS msg_id, ts,
  CASE WHEN event_type IN ('signup', 'click') THEN 'client_to_upstream' ELSE 'upstream_to_client' END AS direction,
  CASE WHEN event_type = 'error' THEN 'close' ELSE 'text' END AS opcode,
  CASE event_type WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'response.create' WHEN 1 THEN 'turn/start' ELSE 'conversation.item.create' END
                  WHEN 'click' THEN 'turn/steer' WHEN 'view' THEN 'response.delta'
                  WHEN 'purchase' THEN 'turn/completed' ELSE '' END AS msg_type,
  CAST(length(props) AS BIGINT) AS bytes,
  CASE WHEN event_type = 'error' THEN 1000 + event_id % 4 ELSE 0 END AS close_code
FROM events
"""

CHECKPOINTS = """
SELECT 'cp_' || conv_id || '_' || turn AS id, 'conv-' || conv_id AS group_id, conv_id, turn, role,
  'org-' || (conv_id % 3) AS org_id, 'ws-0' AS workspace_id,
  TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 MINUTE + turn * INTERVAL 5 SECOND AS created_at,
  CASE WHEN turn > 0 THEN 'cp_' || conv_id || '_' || (turn - 1) END AS parent_id,
  CASE WHEN length(text) % 3 = 0 THEN length(text) % 7 END AS seq, text, length(text) AS size
FROM conversations
"""

EXCHANGES = """
SELECT 'ex_' || a.conv_id || '_' || a.turn AS exchange_id, a.conv_id, a.turn, a.text AS answer, coalesce(q.text, '') AS question,
  length(coalesce(q.text, '')) AS n_in, length(a.text) AS n_out, a.conv_id % 3 AS fam, a.turn % 4 = 1 AS streaming,
  TIMESTAMP '2024-01-01' + a.conv_id * INTERVAL 1 MINUTE + a.turn * INTERVAL 5 SECOND AS started_at
FROM conversations a LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
WHERE a.role = 'assistant'
"""

_BODIES = {
    "raw_traces": (RAW_TRACES, ()),
    "traces": (TRACES, ("raw_traces",)),
    "prices": (PRICES, ()),
    "access_keys": (ACCESS_KEYS, ()),
    "ws_messages": (WS_MESSAGES, ()),
    "checkpoints": (CHECKPOINTS, ()),
    "exchanges": (EXCHANGES, ()),
}


def with_tables(sql: str, *names: str) -> str:
    """Prefix a SELECT with the CTEs it reads."""
    needed: list[str] = []

    def add(name: str) -> None:
        body, before = _BODIES[name]
        for b in before:
            add(b)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({_BODIES[n][0].strip()})" for n in needed)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


def on_traces(sql: str) -> str:
    return with_tables(sql, "traces")
