"""Ordered response parts (text, refusal, thinking, tool calls, ...) from any response body.

Every event or document becomes a list of contributions (part key, field, value). Contributions are
then folded per part key. A body is one row and bounded by the capture cap, so all of this is a
column expression: nothing is shuffled and a busy model is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import sqltext as q
from tracelake.functions.payloads import _captured, looks_like_sse_sql, socket_payload_sql, sse_events_sql

SCHEMA_VERSION = "llm_response_content.v1"

RESPONSES, CHAT, MESSAGES = "openai_response", "openai_chat", "anthropic"

_NONE = "CAST(NULL AS VARIANT)"

# Event name fragment -> (part type, category), tried in this order.
EVENT_KINDS = (
    (("output_text",), "text", "output_text"),
    (("refusal",), "refusal", "refusal"),
    (("reasoning", "thinking"), "thinking", "thinking"),
    (("function_call_arguments", "tool_call_arguments"), "tool_call", "tool_call_arguments"),
    (("mcp_call_arguments",), "tool_call", "mcp_call_arguments"),
    (("custom_tool_call_input",), "tool_call", "custom_tool_call_input"),
    (("transcript",), "audio_transcript", "audio_transcript"),
)


def category_sql(event: str) -> str:
    whens = " ".join(f"WHEN {q.contains_any(event, *words)} THEN '{category}'" for words, _, category in EVENT_KINDS)
    return f"CASE {whens} ELSE {event} END"


def event_category(event: str) -> Column:
    return F.expr(category_sql(event))


def _add(key: str, typ: str, source: str, field: str, value: str, mode: str = "append", doc: str = _NONE) -> str:
    return (
        f"named_struct('key', {key}, 'typ', {typ}, 'source', '{source}', 'field', '{field}', 'mode', '{mode}', "
        f"'value', {value}, 'doc', {doc})"
    )


def _text(key: str, typ: str, source: str, value: str, mode: str = "append") -> str:
    """Blank text leaves no trace: its contribution is dropped by :func:`_list`."""
    return _add(key, f"'{typ}'", source, "text", f"if({q.trim(value)} = '', NULL, {value})", mode)


def _tool(key: str, source: str, *parts: tuple[str, str, str]) -> list[str]:
    return [_add(key, "'tool_call'", source, f, v, m) for f, v, m in parts]


def _tool_input(key: str, source: str, doc: str) -> str:
    """A tool's input document; JSON null counts as none."""
    return _add(key, "'tool_call'", source, "input", "''", "set", f"if(({q.kind(doc)}) = 'VOID', NULL, {doc})")


def _list(*entries: str) -> str:
    return f"filter(array({', '.join(entries)}), z -> z.value IS NOT NULL)"


_EMPTY = f"filter(array({_add(*(chr(39) * 2,) * 2, '', '', 'NULL')}), z -> false)".replace("'value', NULL", "'value', CAST(NULL AS STRING)")


def _join(*lists: str) -> str:
    return f"concat({', '.join(lists)})"


def _each(listed: str, make) -> str:
    x, i = q.fresh("x"), q.fresh("i")
    return f"flatten(transform({listed}, ({x}, {i}) -> {make(x, i)}))"


# ---- pieces of the three dialects ---------------------------------------------------------------


def _content_part(key: str, part: str, source: str) -> str:
    typ = q.trim(q.text(part, "type"))

    def entry(kind: str, *names: str) -> str:
        value = q.text(part, names[0]) if len(names) == 1 else q.first_filled(*[q.text(part, n) for n in names])
        return _list(_text(key, kind, source, value))

    return q.let(
        typ,
        lambda t: f"""CASE WHEN {t} IN ('output_text', 'text') THEN {entry('text', 'text')}
        WHEN {t} = 'refusal' THEN {entry('refusal', 'refusal', 'text')}
        WHEN contains({t}, 'audio') THEN {entry('audio_transcript', 'transcript', 'text')}
        WHEN {q.contains_any(t, 'reasoning', 'thinking')} THEN {entry('thinking', 'text', 'thinking')} ELSE {_EMPTY} END""",
    )


def _part_key(item_id: str, index: str, part: str) -> str:
    category = q.let(
        q.trim(q.text(part, "type")),
        lambda t: f"""CASE WHEN {t} IN ('output_text', 'text') THEN 'output_text' WHEN {t} = 'refusal' THEN 'refusal'
        WHEN contains({t}, 'audio') THEN 'audio_transcript' WHEN {q.contains_any(t, 'reasoning', 'thinking')} THEN 'thinking' ELSE 'content' END""",
    )
    return f"concat('{RESPONSES}:', {item_id}, ':', {index}, ':', {category})"


def _item_content(e: str) -> str:
    return _each(
        q.items(q.member(f"{e}.v", "content")),
        lambda p, i: f"if({q.is_object(p)}, {_content_part(_part_key(f'{e}.id', i, p), p, RESPONSES)}, {_EMPTY})",
    )


def _item_rest(e: str) -> str:
    """Everything of an output item besides its content list."""
    item, key, t = f"{e}.v", f"concat('{RESPONSES}:', {e}.id)", f"{e}.t"
    summaries = _each(
        q.items(q.member(item, "summary")),
        lambda s, i: _list(_text(f"concat({key}, ':summary:', {i})", "thinking", RESPONSES, q.text(s, "text"))),
    )
    reasoning = _join(
        summaries,
        _list(
            _text(f"concat({key}, ':text')", "thinking", RESPONSES, q.text(item, "text")),
            _text(f"concat({key}, ':summary')", "thinking", RESPONSES, q.text(item, "summary_text")),
        ),
    )
    tool_key = f"concat({key}, ':tool')"
    tool = _list(
        *_tool(
            tool_key,
            RESPONSES,
            ("id", f"{e}.id", "set"),
            ("name", q.first_filled(q.text(item, "name"), t), "set"),
            ("arguments", q.text(item, "arguments"), "append"),
        ),
        _tool_input(tool_key, RESPONSES, q.member(item, "input")),
    )
    plain = _list(_text(f"concat({key}, ':text')", "text", RESPONSES, q.text(item, "text")))
    return f"""CASE WHEN contains({t}, 'reasoning') THEN {reasoning}
        WHEN {t} = 'function_call' OR {q.contains_any(t, 'tool_call', 'mcp_call')} THEN {tool}
        WHEN {t} = 'message' THEN {_EMPTY} ELSE {plain} END"""


def _output_text(e: str) -> str:
    return _list(_text(f"'{RESPONSES}:output_text'", "text", RESPONSES, q.text(f"{e}.v", "output_text")))


def _chat_key(e: str, name: str) -> str:
    return f"concat('{CHAT}:choice:', {e}.idx, ':{name}')"


def _chat_texts(e: str) -> str:
    m = f"{e}.v"
    return _list(
        _text(_chat_key(e, "refusal"), "refusal", CHAT, q.text(m, "refusal")),
        _text(_chat_key(e, "thinking"), "thinking", CHAT, q.text(m, "reasoning_content")),
        _text(_chat_key(e, "thinking"), "thinking", CHAT, q.text(m, "thinking")),
        _text(_chat_key(e, "reasoning"), "reasoning", CHAT, q.text(m, "reasoning")),
        _text(_chat_key(e, "audio_transcript"), "audio_transcript", CHAT, q.text(m, "audio.transcript")),
    )


def _chat_content(e: str) -> str:
    content = q.member(f"{e}.v", "content")
    plain = _list(_text(_chat_key(e, "text"), "text", CHAT, q.text(f"{e}.v", "content")))

    def part(p: str, i: str) -> str:
        key = f"concat({_chat_key(e, 'text:')}, {i})"
        return f"if({q.is_object(p)}, {_content_part(key, p, CHAT)}, {_EMPTY})"

    return _join(plain, _each(q.items(content), part))


def _chat_tools(e: str) -> str:
    def call(t: str, i: str) -> str:
        key = f"concat({_chat_key(e, 'tool:')}, {q.number_at(t, 'index', i)})"
        entries = _tool(
            key,
            CHAT,
            ("id", q.text(t, "id"), "set"),
            ("name", q.text(t, "name"), "set"),
            ("name", q.text(t, "function.name"), "set"),
            ("arguments", q.text(t, "function.arguments"), "append"),
            ("arguments", q.text(t, "arguments"), "append"),
        )
        return f"if({q.is_object(t)}, {_list(*entries)}, {_EMPTY})"

    calls = _each(q.items(q.member(f"{e}.v", "tool_calls")), call)
    fn = q.member(f"{e}.v", "function_call")
    single = _tool(_chat_key(e, "function_call"), CHAT, ("name", q.text(fn, "name"), "set"), ("arguments", q.text(fn, "arguments"), "append"))
    return _join(calls, f"if({q.is_object(fn)}, {_list(*single)}, {_EMPTY})")


def _block(b: str, index: str) -> str:
    typ = q.trim(q.text(b, "type"))

    def key(name: str) -> str:
        return f"concat('{MESSAGES}:', {index}, ':{name}')"

    thinking = _list(_text(key("thinking"), "thinking", MESSAGES, q.first_filled(q.text(b, "thinking"), q.text(b, "text"))))
    tool = _list(
        *_tool(key("tool"), MESSAGES, ("id", q.text(b, "id"), "set"), ("name", q.first_filled(q.text(b, "name"), typ), "set")),
        _tool_input(key("tool"), MESSAGES, q.member(b, "input")),
    )
    return q.let(
        typ,
        lambda t: f"""CASE WHEN {t} = 'text' THEN {_list(_text(key('text'), 'text', MESSAGES, q.text(b, 'text')))}
        WHEN {t} IN ('thinking', 'redacted_thinking') THEN {thinking}
        WHEN {t} IN ('tool_use', 'server_tool_use') THEN {tool} ELSE {_EMPTY} END""",
    )


def _blocks(v: str) -> str:
    return _each(q.items(q.member(v, "content")), lambda b, i: f"if({q.is_object(b)}, {_block(b, i)}, {_EMPTY})")


def _messages_event(v: str) -> str:
    index = q.number_at(v, "index", "0")

    def key(name: str) -> str:
        return f"concat('{MESSAGES}:', {index}, ':{name}')"

    start, delta = q.member(v, "content_block"), q.member(v, "delta")
    grown = f"""CASE {q.text(v, 'delta.type')}
        WHEN 'text_delta' THEN {_list(_text(key('text'), 'text', MESSAGES, q.text(delta, 'text')))}
        WHEN 'input_json_delta' THEN {_list(*_tool(key('tool'), MESSAGES, ('arguments', q.text(delta, 'partial_json'), 'append')))}
        WHEN 'thinking_delta' THEN {_list(_text(key('thinking'), 'thinking', MESSAGES, q.text(delta, 'thinking')))} ELSE {_EMPTY} END"""
    return f"""CASE {q.text(v, 'type')} WHEN 'content_block_start' THEN if({q.is_object(start)}, {q.let(start, lambda b: _block(b, index))}, {_EMPTY})
        WHEN 'content_block_delta' THEN {grown} ELSE {_EMPTY} END"""


def _event_key(t: str, v: str) -> str:
    spot = f"concat('output:', {q.number_at(v, 'output_index', '0')})"
    item = q.first_filled(q.text(v, "item_id"), q.text(v, "output_item_id"), q.text(v, "call_id"), spot)
    return f"concat('{RESPONSES}:', {item}, ':', {q.number_at(v, 'content_index', '0')}, ':', {category_sql(t)})"


# Events that carry finished objects instead of deltas.
_DONE_EVENTS = "'response.completed', 'response.done'"
_WHOLE_EVENTS = _DONE_EVENTS + ", 'response.output_item.done', 'response.content_part.done'"


def _responses_event(t: str, v: str, key: str) -> str:
    """Contributions of an event that carries a delta or a final text."""

    def delta(typ: str, final: str) -> str:
        return _list(_text(key, typ, RESPONSES, q.text(v, "delta")), _text(key, typ, RESPONSES, q.text(v, final), "longer"))

    def arguments(final: str, *name: str) -> str:
        named = [("name", f"'{n}'", "set") for n in name]
        return _list(*_tool(key, RESPONSES, *named, ("arguments", q.text(v, "delta"), "append"), ("arguments", q.text(v, final), "longer")))

    by_kind = {
        "output_text": delta("text", "text"),
        "refusal": delta("refusal", "refusal"),
        "thinking": delta("thinking", "text"),
        "tool_call_arguments": arguments("arguments"),
        "mcp_call_arguments": arguments("arguments", "mcp_call"),
        "custom_tool_call_input": arguments("input", "custom_tool_call"),
        "audio_transcript": delta("audio_transcript", "text"),
    }
    whens = " ".join(f"WHEN {q.contains_any(t, *words)} THEN {by_kind[category]}" for words, _, category in EVENT_KINDS)
    return f"CASE WHEN {t} IN ({_WHOLE_EVENTS}) THEN {_EMPTY} {whens} ELSE {_EMPTY} END"


def _finished_part(t: str, v: str) -> str:
    spot = f"concat('output:', {q.number_at(v, 'output_index', '0')})"
    owner = q.first_filled(q.text(v, "item_id"), q.text(v, "output_item_id"), spot)
    part = q.member(v, "part")
    part_key = _part_key(owner, q.number_at(v, "content_index", "0"), part)
    return f"if({t} = 'response.content_part.done' AND {q.is_object(part)}, {_content_part(part_key, part, RESPONSES)}, {_EMPTY})"


_FILLED = "(z.field <> 'id' AND (" + q.trim("z.value") + " <> '' OR z.doc IS NOT NULL))"


def _folded(rows: str, field: str) -> str:
    """Text built from appends; a final value replaces it only if longer in bytes.

    Appends between two final values are joined at once, so a long stream is joined in one go.
    """

    def build(mine: str) -> str:
        stops = f"filter(transform({mine}, (z, n) -> if(z.mode = 'longer', n + 1, NULL)), n -> n IS NOT NULL)"

        def fold(ends: str) -> str:
            since = f"if(j = 0, 0, {ends}[j - 1])"
            until = f"if(j < size({ends}), {ends}[j] - 1, size({mine}))"
            grown = f"concat(acc, array_join(transform(slice({mine}, {since} + 1, {until} - {since}), z -> z.value), ''))"
            final = f"{mine}[{ends}[j] - 1].value"
            step = q.let(
                grown,
                lambda g: f"if(j < size({ends}), if(octet_length({final}) > octet_length({g}), {final}, {g}), {g})",
            )
            return f"aggregate(sequence(0, size({ends})), '', (acc, j) -> {step})"

        return q.let(stops, fold)

    return q.let(f"filter({rows}, z -> z.field = '{field}')", build)


def _parts(contributions: str) -> str:
    def make(c: str) -> str:
        def part(rows: str) -> str:
            def last(field: str) -> str:
                return f"coalesce(try_element_at(filter(transform(filter({rows}, z -> z.field = '{field}'), z -> {q.filled('z.value')}), t -> t IS NOT NULL), -1), '')"

            doc = f"try_element_at(filter(transform(filter({rows}, z -> z.field = 'input'), z -> z.doc), d -> d IS NOT NULL), -1)"
            return (
                f"named_struct('arguments', {_folded(rows, 'arguments')}, 'id', {last('id')}, 'input', {doc}, 'name', {last('name')}, "
                f"'source', {rows}[0].source, 'text', {_folded(rows, 'text')}, 'type', {rows}[0].typ)"
            )

        k = q.fresh("k")
        mine = f"filter({c}, z -> z.key = {k})"
        return f"transform(array_distinct(transform({c}, z -> z.key)), {k} -> {q.let(mine, part)})"

    filled = f"({q.trim('p.text')} <> '' OR {q.trim('p.arguments')} <> '' OR {q.trim('p.name')} <> '' OR p.input IS NOT NULL)"
    return f"filter({q.let(contributions, make)}, p -> {filled})"


# Where an event comes from. A later source only counts if the earlier ones gave nothing.
_STREAM, _SOCKET, _DOCUMENT = 0, 1, 2

# Behind all items of the same object.
_LAST = 1 << 30


def _contributions(events: str, make, dialect: int, step: int = 0) -> str:
    """Contributions of all events, stamped with their place in the body."""
    e, z, n = q.fresh("e"), q.fresh("z"), q.fresh("n")
    copied = ", ".join(f"'{f}', {z}.{f}" for f in ("key", "typ", "source", "field", "mode", "value", "doc"))
    place = f"'phase', {e}.phase, 'pos', {e}.pos, 'dialect', {dialect}, 'sub', bigint({e}.sub), 'step', {step}, 'n', {n}"
    stamped = f"transform({make(e)}, ({z}, {n}) -> named_struct({copied}, 'at', named_struct({place}), 'only_first', {e}.only_first))"
    return f"flatten(transform({events}, {e} -> {stamped}))"


def _entry(e: str, v: str, sub: str = "0", only_first: str = "false", **more: str) -> str:
    rest = "".join(f", '{n}', {x}" for n, x in more.items())
    return f"named_struct('phase', {e}.phase, 'pos', {e}.pos, 'sub', {sub}, 'only_first', {only_first}, 'v', {v}{rest})"


def _by_source(df: DataFrame, body: str, streaming: str) -> DataFrame:
    """Events of the stream, of a captured socket, and the document itself, as one list."""
    text = f"coalesce({body}, '')"
    parsed = q.let("try_parse_json(e.data)", q.as_object)
    stream = f"filter(transform({sse_events_sql(text)}, e -> named_struct('event', e.event, 'v', {parsed})), e -> e.v IS NOT NULL)"
    nothing = f"filter(array(named_struct('event', '', 'v', {_NONE})), e -> false)"
    df = df.withColumns(
        {"_doc": F.expr(f"try_parse_json({text})"), "_sse": F.expr(f"if({streaming} OR {looks_like_sse_sql(text)}, {stream}, {nothing})")}
    )
    heard = f"filter(transform({_captured('_doc', 'upstream_to_client')}, w -> {socket_payload_sql('w')}), p -> p IS NOT NULL)"
    df = df.withColumn("_ws", F.expr(f"if({q.is_array('_doc')}, {heard}, filter(array({_NONE}), e -> false))"))

    def tagged(listed: str, phase: int, event: str, v: str) -> str:
        done = f"{q.trim(event)} IN ({_DONE_EVENTS})"
        return f"transform({listed}, (e, i) -> named_struct('phase', {phase}, 'pos', i, 'sub', 0, 'only_first', {done}, 'v', {v}, 't', {q.trim(event)}))"

    streamed = tagged("_sse", _STREAM, f"coalesce(nullif(e.event, ''), {q.text('e.v', 'type')})", "e.v")
    socket = tagged("_ws", _SOCKET, f"coalesce(nullif({q.text('e', 'type')}, ''), {q.text('e', 'method')})", "e")
    whole = f"named_struct('phase', {_DOCUMENT}, 'pos', 0, 'sub', 0, 'only_first', false, 'v', _doc, 't', '')"
    return df.withColumn("_events", F.expr(f"concat({streamed}, {socket}, filter(array({whole}), e -> {q.is_object('e.v')}))"))


def _objects_and_items(df: DataFrame) -> DataFrame:
    """Response objects, their output items and chat messages found in the events."""
    live = f"filter(_events, e -> e.phase < {_DOCUMENT})"
    final = f"filter(_events, e -> e.phase = {_DOCUMENT})"
    response = q.as_object(q.member("e.v", "response"))
    in_events = f"transform(filter({live}, e -> e.only_first), e -> {_entry('e', response, only_first='true')})"
    in_document = f"transform({final}, e -> {_entry('e', response)})"
    itself = f"transform({final}, e -> {_entry('e', 'e.v', sub='1')})"
    df = df.withColumns(
        {
            "_live": F.expr(f"transform({live}, e -> {_entry('e', 'e.v', t='e.t', key=_event_key('e.t', 'e.v'))})"),
            "_objects": F.expr(f"filter(concat({in_events}, {in_document}, {itself}), o -> o.v IS NOT NULL)"),
        }
    )
    # An object's items stand before its output_text; the document's own come after those of its response.
    item = _entry("o", "x", sub=f"o.sub * {2 * _LAST}L + i", only_first="o.only_first", idx="i")
    listed = f"flatten(transform(_objects, o -> transform({q.items(q.member('o.v', 'output'))}, (x, i) -> {item})))"
    done = f"filter(_events, e -> e.phase < {_DOCUMENT} AND e.t = 'response.output_item.done')"
    index = "int(" + q.number_at("e.v", "output_index", "0") + ")"
    single = f"transform({done}, e -> {_entry('e', q.member('e.v', 'item'), sub='0L', idx=index)})"
    message, delta = (
        _entry("e", q.as_object(q.member("c", name)), sub=f"2 * i + {n}", idx=q.number_at("c", "index", "i"))
        for n, name in enumerate(("message", "delta"))
    )
    choices = f"flatten(transform(_events, e -> flatten(transform({q.items(q.member('e.v', 'choices'))}, (c, i) -> array({message}, {delta})))))"
    df = df.withColumns(
        {
            "_raw_items": F.expr(f"filter(concat({listed}, {single}), x -> {q.is_object('x.v')})"),
            "_messages": F.expr(f"filter({choices}, x -> x.v IS NOT NULL)"),
        }
    )
    ident = q.first_filled(q.text("x.v", "id"), q.text("x.v", "call_id"), "concat('item:', x.idx)")
    named = _entry("x", "x.v", sub="x.sub", only_first="x.only_first", id=ident, t=q.trim(q.text("x.v", "type")))
    texts = _entry("o", "o.v", sub=f"o.sub * {2 * _LAST}L + {_LAST}", only_first="o.only_first")
    return df.withColumns(
        {"_items": F.expr(f"transform(_raw_items, x -> {named})"), "_texts": F.expr(f"transform(_objects, o -> {texts})")}
    )


def add_response_parts(df: DataFrame, body: str, streaming: str, out: str) -> DataFrame:
    """Add ``out``: the response's parts as array of (arguments, id, input, name, source, text, type).

    '' and NULL mean absent. The steps are separate columns only to keep each expression shallow;
    it stays one projection without a shuffle.
    """
    given = df.columns
    df = _objects_and_items(_by_source(df, body, streaming))
    lists = {
        "_c0": _contributions("_live", lambda e: _responses_event(f"{e}.t", f"{e}.v", f"{e}.key"), 0),
        "_c1": _contributions("_live", lambda e: _finished_part(f"{e}.t", f"{e}.v"), 0, 1),
        "_c2": _contributions("_items", _item_content, 1),
        "_c3": _contributions("_items", _item_rest, 1, 1),
        "_c4": _contributions("_texts", _output_text, 1),
        "_c5": _contributions("_messages", _chat_content, 2),
        "_c6": _contributions("_messages", _chat_texts, 2, 1),
        "_c7": _contributions("_messages", _chat_tools, 2, 2),
        "_c8": _contributions("_live", lambda e: _messages_event(f"{e}.v"), 3),
        "_c9": _contributions(f"filter(_events, e -> e.phase = {_DOCUMENT})", lambda e: _blocks(f"{e}.v"), 3),
    }
    df = df.withColumns({n: F.expr(sql) for n, sql in lists.items()})
    joined = f"concat({', '.join(lists)})"
    used = " + ".join(f"int(size({c}) > 0)" for c in lists)
    by_place = f"array_sort({joined}, (a, b) -> CASE WHEN a.at < b.at THEN -1 WHEN a.at > b.at THEN 1 ELSE 0 END)"
    df = df.withColumn("_all", F.expr(f"if({used} > 1, {by_place}, {joined})"))
    df = df.withColumn("_first", F.expr(f"array_min(transform(filter(_all, z -> {_FILLED}), z -> struct(z.at.phase, z.at.pos)))"))
    # Content of the earliest filled source only; a finished response after other content is dropped.
    late = "z.only_first AND struct(z.at.phase, z.at.pos) > _first"
    df = df.withColumn("_kept", F.expr(f"filter(_all, z -> _first IS NULL OR (z.at.phase <= _first.phase AND NOT ({late})))"))
    return df.select(*given, F.expr(_parts("_kept")).alias(out))


def response_content(parts: Column) -> Column:
    """The response document as JSON text, NULL if it has no parts."""

    def named(p: Column) -> Column:
        absent = [F.nullif(p[n], F.lit("")).alias(n) for n in ("arguments", "id")]
        rest = [F.nullif(p[n], F.lit("")).alias(n) for n in ("name", "source", "text")]
        return F.struct(*absent, p["input"].alias("input"), *rest, p["type"].alias("type"))

    document = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.transform(parts, named).alias("parts"))
    return F.when(F.size(parts) > 0, F.to_json(document))
