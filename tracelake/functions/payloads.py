"""Model, token usage and prompt from request and response bodies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import sqltext as q

# ---- server-sent events -------------------------------------------------------------------------


def sse_payloads_sql(body: str) -> str:
    """Trimmed ``data:`` lines, blanks and the end mark left out."""
    lines = f"transform(split({body}, '\\n'), l -> {q.trim('l')})"
    data = f"transform(filter({lines}, l -> startswith(l, 'data:')), l -> {q.trim('substring(l, 6)')})"
    return f"filter({data}, d -> d <> '' AND d <> '[DONE]')"


def sse_payloads(body: str) -> Column:
    return F.expr(sse_payloads_sql(body))


def sse_events_sql(body: str) -> str:
    """Blocks between blank lines as (event, data); data lines are joined by newlines."""
    lines = "transform(split(b, '\\n'), l -> rtrim('\\r', l))"
    event = f"coalesce(element_at(filter(transform({lines}, l -> if(startswith(l, 'event:'), {q.trim('substring(l, 7)')}, NULL)), x -> x IS NOT NULL), -1), '')"
    event = event.replace("element_at(", "try_element_at(")
    data = f"array_join(filter(transform({lines}, l -> if(startswith(l, 'data:'), {q.filled('substring(l, 6)')}, NULL)), x -> x IS NOT NULL), '\\n')"
    blocks = f"split(replace({body}, '\\r\\n', '\\n'), '\\n\\n')"
    made = f"transform({blocks}, b -> named_struct('event', {event}, 'data', {data}))"
    return f"filter({made}, e -> e.data <> '' AND {q.trim('e.data')} <> '[DONE]')"


def sse_events(body: str) -> Column:
    return F.expr(sse_events_sql(body))


def looks_like_sse_sql(body: str) -> str:
    return f"(startswith({q.trim(body)}, 'data:') OR contains({q.trim(body)}, '\\ndata:'))"


# ---- model and usage ----------------------------------------------------------------------------
#
# Flat documents (and one level of ``response``) stay in the JVM. Documents that nest deeper, through
# ``payload``, arrays or repeated ``response``, are rare; only their text is sent to a small recursive
# helper, every other row sends NULL.


def _usage_object(v: str) -> str:
    spots = ", ".join(q.as_object(q.member(v, p)) for p in ("usage", "message.usage", "response.usage"))
    return f"coalesce({spots})"


_TRIPLE = "struct<i:bigint,o:bigint,t:bigint>"


def _flat_usage(v: str) -> str:
    def make(u: str) -> str:
        i = f"coalesce({q.number(q.member(u, 'prompt_tokens'))}, {q.number(q.member(u, 'input_tokens'))}, 0)"
        o = f"coalesce({q.number(q.member(u, 'completion_tokens'))}, {q.number(q.member(u, 'output_tokens'))}, 0)"
        t = f"coalesce(nullif({q.number(q.member(u, 'total_tokens'))}, 0), {i} + {o})"
        return f"named_struct('i', {i}, 'o', {o}, 't', {t})"

    return q.let(_usage_object(v), make)


def _usage_sql(v: str) -> str:
    inner, own = _flat_usage(q.as_object(q.member(v, "response"))), _flat_usage(v)
    return q.let(inner, lambda r: f"if({r}.i > 0 OR {r}.o > 0 OR {r}.t > 0, {r}, {own})")


def _model_sql(v: str) -> str:
    spots = ("response.model", "response.message.model", "model", "message.model")
    return "coalesce(" + ", ".join(q.filled(q.as_text(q.member(v, p))) for p in spots) + ")"


def _nests_sql(v: str) -> str:
    """Needs the recursive helper."""
    inner = q.member(v, "response")
    deep = [f"{q.member(v, 'payload')} IS NOT NULL", q.is_array(inner)]
    deep += [f"{q.member(inner, p)} IS NOT NULL" for p in ("payload", "response")]
    return f"({q.is_array(v)} OR {' OR '.join(deep)})"


# What a document may wrap, innermost first, and the names of the counts.
_WRAPPED = ("payload", "response")
_COUNTS = (("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens"), ("total_tokens",))
_NOTHING = ("", (0, 0, 0))


def _count(usage: dict, names: tuple[str, ...]) -> int:
    numbers = (usage.get(n) for n in names)
    return next((int(v) for v in numbers if isinstance(v, (int, float)) and not isinstance(v, bool)), 0)


def _stated(node: dict) -> tuple[str, tuple[int, int, int]]:
    """What a document says itself, or in its message."""
    inner = [h for h in (node.get("message"), node.get("response")) if isinstance(h, dict)]
    models = [h.get("model") for h in (node, *inner) if h is not node.get("response")]
    model = next((m.strip() for m in models if isinstance(m, str) and m.strip()), "")
    usage = next((h["usage"] for h in (node, *inner) if isinstance(h.get("usage"), dict)), None)
    if usage is None:
        return model, (0, 0, 0)
    i, o, t = (_count(usage, names) for names in _COUNTS)
    return model, (i, o, t or i + o)


def _later_wins(triples) -> tuple[int, int, int]:
    """Of each count the last positive one; the total is at least their sum."""
    i, o, t = (next((v for v in reversed(column) if v > 0), 0) for column in (list(zip(*triples)) or [(), (), ()]))
    return i, o, max(t, i + o)


def _facts(root) -> tuple[str, tuple[int, int, int]]:
    """Model and usage of a parsed document. What it wraps comes before what it says itself.

    Parts are settled before the whole on a list of open nodes, so depth costs no stack.
    """
    known: dict[int, tuple] = {}
    open_nodes = [root]
    while open_nodes:
        node = open_nodes[-1]
        parts = node if isinstance(node, list) else [node.get(n) for n in _WRAPPED] if isinstance(node, dict) else []
        parts = [p for p in parts if isinstance(p, (dict, list))]
        unknown = [p for p in parts if id(p) not in known]
        if unknown:
            open_nodes.extend(unknown)
            continue
        open_nodes.pop()
        found = [known[id(p)] for p in parts]
        if isinstance(node, dict):
            found.append(_stated(node))
            usage = next((u for _, u in found if max(u) > 0), (0, 0, 0))
        else:
            usage = _later_wins([u for _, u in found])
        known[id(node)] = (next((m for m, _ in found if m), ""), usage)
    return known.get(id(root), _NOTHING)


def _load(text: str):
    """The document, or None for what is no JSON or nested deeper than the parser goes."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


_NESTED = T.StructType(
    [T.StructField("model", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("i", "o", "t")]]
)


@F.pandas_udf(_NESTED)
def nested_facts(documents: pd.Series) -> pd.DataFrame:
    """Model and usage of documents given as JSON arrays of payload texts, in order."""
    rows = []
    for listed in documents:
        if listed is None:
            rows.append((None, None, None, None))
            continue
        nodes = [_load(p) for p in json.loads(listed)]
        facts = [_facts(n) for n in nodes]
        model = next((m for m, _ in facts if m), "")
        usage = [u for _, u in facts]
        rows.append((model, *(usage[0] if len(usage) == 1 else _later_wins(usage))))
    return pd.DataFrame(rows, columns=["model", "i", "o", "t"])


_FACTS = "struct<model:string,i:bigint,o:bigint,t:bigint,nested:string>"


def _facts_sql(body: str, streaming: str) -> str:
    """Flat facts of a body: payload list -> first model, last positive counts."""
    whole = f"array(named_struct('v', try_parse_json({body}), 'p', {body}))"
    events = f"transform({sse_payloads_sql(body)}, p -> named_struct('v', try_parse_json(p), 'p', p))"
    listed = f"if({streaming} AND try_parse_json({body}) IS NULL, {events}, {whole})"

    def make(ps: str) -> str:
        model = f"coalesce(get(filter(transform({ps}, x -> {_model_sql('x.v')}), m -> m IS NOT NULL), 0), '')"
        usage = (
            f"aggregate(transform({ps}, x -> {_usage_sql('x.v')}), named_struct('i', 0L, 'o', 0L, 't', 0L), "
            "(a, x) -> named_struct('i', if(x.i > 0, x.i, a.i), 'o', if(x.o > 0, x.o, a.o), 't', if(x.t > 0, x.t, a.t)))"
        )
        total = f"if(size({ps}) = 1, {{u}}.t, greatest({{u}}.t, {{u}}.i + {{u}}.o))"
        nested = f"if(exists({ps}, x -> {_nests_sql('x.v')}), to_json(transform({ps}, x -> x.p)), NULL)"
        return q.let(
            usage,
            lambda u: f"named_struct('model', {model}, 'i', {u}.i, 'o', {u}.o, 't', {total.format(u=u)}, 'nested', {nested})",
        )

    return q.let(listed, make)


def body_facts(df, body: str, streaming: str, prefix: str):
    """Add ``{prefix}_model``, ``_in``, ``_out`` and ``_total`` read from a JSON or event-stream body."""
    flat, deep = f"_{prefix}_flat", f"_{prefix}_deep"
    found = df.withColumn(flat, F.expr(_facts_sql(f"coalesce({body}, '')", streaming)))
    found = found.withColumn(deep, nested_facts(F.col(f"{flat}.nested")))
    nested = F.col(f"{flat}.nested").isNotNull()

    def pick(name: str) -> Column:
        return F.when(nested, F.col(f"{deep}.{name}")).otherwise(F.col(f"{flat}.{name}"))

    return found.withColumns(
        {f"{prefix}_model": pick("model"), f"{prefix}_in": pick("i"), f"{prefix}_out": pick("o"), f"{prefix}_total": pick("t")}
    ).drop(flat, deep)


def chunk_delta_tokens(chunk: str) -> Column:
    """Tokens one transport chunk reports: those of its last JSON payload, output before total."""
    listed = sse_payloads_sql(chunk)
    last = q.let(listed, lambda ps: f"coalesce(try_element_at(filter({ps}, p -> startswith(p, '{{')), -1), try_element_at({ps}, -1), {chunk})")
    usage = _plain_usage(f"try_parse_json({q.trim(last)})")
    return F.expr(q.let(usage, lambda u: f"CASE WHEN {u}.o > 0 THEN {u}.o WHEN {u}.t > 0 THEN {u}.t ELSE 0L END"))


def _plain_usage(v: str) -> str:
    """Usage straight below the root only."""
    return q.let(
        q.as_object(q.member(v, "usage")),
        lambda u: q.let(
            f"named_struct('i', coalesce({q.number(q.member(u, 'prompt_tokens'))}, {q.number(q.member(u, 'input_tokens'))}, 0),"
            f" 'o', coalesce({q.number(q.member(u, 'completion_tokens'))}, {q.number(q.member(u, 'output_tokens'))}, 0),"
            f" 'n', coalesce({q.number(q.member(u, 'total_tokens'))}, 0))",
            lambda x: f"named_struct('o', {x}.o, 't', coalesce(nullif({x}.n, 0), {x}.i + {x}.o))",
        ),
    )


# ---- prompt -------------------------------------------------------------------------------------


def _text_value(v: str) -> str:
    """Text, or the text parts of a list joined by newlines; NULL if nothing is left."""
    kind_of = q.trim(q.text("p", "type"))
    part = f"""CASE WHEN ({q.kind('p')}) = 'STRING' THEN {q.filled(q.as_text('p'))}
      WHEN {q.is_object('p')} AND {kind_of} IN ('', 'text', 'input_text') THEN {q.filled(q.text('p', 'text'))} END"""
    joined = f"array_join(filter(transform({q.items(v)}, p -> {part}), t -> t IS NOT NULL), '\\n')"
    return f"if({q.is_array(v)}, {q.filled(joined)}, {q.filled(q.as_text(v))})"


def _message_text(m: str) -> str:
    return f"coalesce({_text_value(q.member(m, 'content'))}, {_text_value(q.member(m, 'text'))})"


def _last_user(v: str) -> str:
    users = f"filter({q.items(v)}, m -> {q.is_object('m')} AND {q.trim(q.text('m', 'role'))} = 'user')"
    return f"try_element_at(filter(transform({users}, m -> {_message_text('m')}), t -> t IS NOT NULL), -1)"


def _prompt_sql(v: str) -> str:
    entered = q.member(v, "input")
    return f"coalesce({_last_user(q.member(v, 'messages'))}, if({q.is_array(entered)}, {_last_user(entered)}, {q.filled(q.as_text(entered))}))"


def socket_payload_sql(m: str) -> str:
    """Payload of a captured socket message: an object, or text that parses to one."""
    p = q.member(m, "payload")
    return f"coalesce({q.as_object(p)}, {q.let(f'try_parse_json({q.as_text(p)})', q.as_object)})"


def _socket_prompt(p: str) -> str:
    item, method = q.as_object(q.member(p, "item")), q.trim(q.text(p, "method"))
    from_item = f"if({q.trim(q.text(p, 'item.role'))} = 'user', {q.let(item, _message_text)}, NULL)"
    from_response = q.let(q.as_object(q.member(p, "response")), _prompt_sql)
    from_turn = f"if({method} IN ('turn/start', 'turn/steer'), {_text_value(q.member(p, 'params.input'))}, NULL)"
    return f"coalesce({_prompt_sql(p)}, {from_item}, {from_response}, {from_turn})"


def _captured(v: str, direction: str) -> str:
    """Text messages of one direction in a captured socket body."""
    return f"filter({q.items(v)}, w -> {q.trim(q.text('w', 'direction'))} = '{direction}' AND {q.trim(q.text('w', 'opcode'))} = 'text')"


def request_prompt(body: str) -> Column:
    """Last user text of a request body; NULL if there is none."""
    sent = f"transform({{}}, w -> {q.let(socket_payload_sql('w'), _socket_prompt)})"

    def make(v: str) -> str:
        from_socket = f"try_element_at(filter({sent.format(_captured(v, 'client_to_upstream'))}, t -> t IS NOT NULL), -1)"
        return f"if({q.is_array(v)}, {from_socket}, {_prompt_sql(v)})"

    return F.expr(q.let(f"try_parse_json({body})", make))
