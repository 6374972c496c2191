"""Messages, behaviour queries and JSON of any shape on golden values and against plain walks."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import exprs as X


def one(spark, column, **values):
    """The value of an expression over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "kind, name, arguments, failed, want",
    [
        ("text", None, None, None, "said"),
        ("thinking", None, None, None, "said"),
        ("tool_call", "bash", '{"b": 1.0, "cmd": "mail a@b.org", "env": {"API_KEY": ["x"]}}', None, '[tool_call:bash] {"b":1,"cmd":"mail [REDACTED]","env":{"API_KEY":"[REDACTED]"}}'),
        ("tool_call", None, None, None, "[tool_call:tool] "),
        ("tool_result", "read", None, False, "[tool_result:read] said"),
        ("tool_result", "read", None, True, "[tool_error:read] said"),
        ("image", None, None, None, ""),
    ],
)
def test_message_parts(spark, kind, name, arguments, failed, want):
    text = F.lit(None).cast("string")
    c = X.message_part(F.lit(kind), F.lit("said"), text if name is None else F.lit(name), text if arguments is None else F.lit(arguments), F.lit(failed).cast("boolean"))
    assert one(spark, c, t=1) == want


def test_visible_text_and_guidance(spark):
    parts = F.array(*(F.struct(F.lit(k).alias("type"), F.lit(t).alias("text")) for k, t in (("text", "a"), ("image", "b"), ("text", "c"))))
    assert one(spark, X.visible_text(parts), t=1) == "ac"
    assert one(spark, X.visible_text(parts, F.lit("plain")), t=1) == "plain"
    assert one(spark, X.visible_text(parts, None, F.lit(False)), t=1) == "" and one(spark, X.visible_text(parts, None, F.lit(None).cast("boolean")), t=1) == "ac"
    habits = lambda *b: F.array(*(F.struct(F.lit(f"c{i}").alias("condition"), F.lit(x).alias("behavior")) for i, x in enumerate(b)))
    assert one(spark, X.guidance(habits("b0", "b1", "b2", "b3")), t=1) == X.GUIDANCE_HEAD + "\n- When: c0\n  Do: b0\n- When: c1\n  Do: b1\n- When: c2\n  Do: b2"
    assert one(spark, X.guidance(habits("mail a@b.org")), t=1) is None
    assert len(one(spark, X.guidance(habits("x" * 5000)), t=1)) == 2000


@pytest.mark.parametrize("text, want", [("Ｆｕｌｌ ①②", "full 12"), ("Straße, №5 ﬁn", "stra e no5 fin"), ("  A--b__C ", "a b c"), ("ÄÖ", ""), ("x²", "x2"), (None, None), ("", "")])
def test_key_text(spark, text, want):
    assert one(spark, X.key_text(F.lit(text).cast("string")), t=1) == want


def test_behavior_source(spark):
    turn = "[tool_call:grep] {}\nRequest: do it\n" + "".join(f"[Tool_Result: r{i} ]  line {i}\n\n" for i in range(9)) + "[tool_error:bad\nname] stays"
    got = one(spark, X.behavior_source(F.lit(turn)), t=1)
    want = [f"tool Result r{i} line {i}" for i in range(8, 0, -1)] + ["assistant action [tool_error:bad name] stays"]
    assert got.split("\n") == want
    assert one(spark, X.behavior_source(F.lit("done.\n Request: more of it\nwell")), t=1) == "assistant action done. well"
    long = "".join(f"w{i} " for i in range(2000)).strip()
    tail, head = one(spark, X.behavior_source(F.lit(long)), t=1).split("\n")
    assert tail == "assistant action " + long[-1200:] and head == "assistant action " + long[:1200]
    assert one(spark, X.behavior_source(F.lit("  \n")), t=1) is None
    payload = one(spark, X.behavior_source(F.lit("[tool_result:x] " + long)), t=1)
    assert payload == " ".join(f"tool result x {long[:600]} {long[-600:]}".split())


@pytest.mark.parametrize("text", ["word " * 6000, "é😀 naïve " * 4000, "short", "[tool_call:x] " + "a1b2 " * 5000])
def test_behavior_query_is_the_longest_prefix_within_the_budget(spark, text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    source = one(spark, X.behavior_source(F.lit(text)), t=1)
    got = one(spark, X.behavior_query(F.lit(text), path, 128), t=1)
    assert 0 < len(coder.encode(got).ids) <= 128
    flat = " ".join(source.split())
    assert flat.startswith(got) and (got == flat or len(coder.encode(flat[: len(got) + 12]).ids) > 127)


def plain_redacted(value, key=""):
    from tracewell.functions.free_json import redact

    if key != "file_generation" and any(k in key.lower().replace("-", "_") for k in ("token", "api_key", "apikey", "secret", "password", "authorization", "private_key", "privatekey", "credential", "path", "file")):
        return X.REDACTED
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, list):
        return [plain_redacted(v) for v in value]
    return {k: plain_redacted(v, k) for k, v in value.items()} if isinstance(value, dict) else value


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.text(max_size=8) | st.sampled_from(["a@b.org", "token=abc", "~/x"]), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "Z", "é", "10", "9", "file_generation", "Api-Key", "path", "x_token"]), inner, max_size=4), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_free_json_against_a_plain_walk(value):
    import json

    from tracewell.functions import free_json as J

    assert json.loads(J.write(J.redacted(value))) == plain_redacted(value)
    assert json.loads(J.write(value, ordered=True)) == value
    turned = lambda v: {k: turned(v[k]) for k in reversed(list(v))} if isinstance(v, dict) else [turned(x) for x in v] if isinstance(v, list) else v
    assert J.write(turned(value), ordered=True) == J.write(value, ordered=True)


@pytest.mark.parametrize(
    "text, redacted, canonical",
    [
        ('{"b": {"y": 1, "x": [1.50, {"q": null, "p": true}]}, "a": "mail a@b.org"}', '{"b":{"y":1,"x":[1.5,{"q":null,"p":true}]},"a":"mail [REDACTED]"}', '{"a":"mail a@b.org","b":{"x":[1.5,{"p":true,"q":null}],"y":1}}'),
        ('{"a": 1, "b": 2, "a": 3}', '{"a":3,"b":2}', '{"a":3,"b":2}'),
        ('{"b": 1, "10": 2, "9": 3}', '{"9":3,"10":2,"b":1}', '{"9":3,"10":2,"b":1}'),
        ('{"file_generation": {"token": [1]}, "credentials": {"deep": 1}}', '{"file_generation":{"token":"[REDACTED]"},"credentials":"[REDACTED]"}', '{"credentials":{"deep":1},"file_generation":{"token":[1]}}'),
        ("[1e21, 1e-7, 0.000001, -0.0, 123456789012345680000, 100, 1.5e300]", "[1e+21,1e-7,0.000001,0,123456789012345680000,100,1.5e+300]", "[1e+21,1e-7,0.000001,0,123456789012345680000,100,1.5e+300]"),
        ('"\\u001f\\n\\"\\\\/"', '"\\u001f\\n\\"\\\\/"', '"\\u001f\\n\\"\\\\/"'),
        ("{broken", None, None),
        ("NaN", None, None),
        ("[" * 100_000, None, None),
        (None, None, None),
        (" 7 ", "7", "7"),
    ],
)
def test_free_json(spark, text, redacted, canonical):
    from tracewell.functions import free_json as J

    c = F.lit(text).cast("string")
    got = spark.range(1).select(J.redact_json(c).alias("r"), J.canonical(c).alias("c")).first()
    assert (got.r, got.c) == (redacted, canonical)


def test_bounded_reading():
    from tracewell.functions import free_json as J

    read = lambda v: J.bounded(v, J._Budget())
    assert read("x" * 3000 + "y") == "x" * 1999 + "y"
    assert read(list(range(20))) == list(range(4, 20)) and len(read({f"k{i}": i for i in range(40)})) == 24
    assert read([[[[["deep"], 1]]]]) == [[[[1]]]] and read({"k" * 300: ""}) == {"k" * 256: ""}
    many = read([["z" * 2000] * 16] * 16)
    assert sum(len(s) for inner in many for s in inner) == 20_000


def test_host_queries(spark):
    from tracewell.operators import retrieval

    long = "u" * 7000 + "v" * 7000
    rows = [(1, 1, "user", "old"), (1, 2, "user", f" {long} "), (1, 3, "assistant", "mail a@b.org"), (2, 1, "assistant", "only"), (3, 1, "system", "s" * 3000), (4, 1, "user", "first"), (4, 2, "user", None), (5, 1, "tool", None)]
    got = {r.conv_id: r.query for r in retrieval.host_query(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1] == f"user: {long[:5995]}...{long[-5995:]}\nassistant: mail [REDACTED]" and got[2] == "assistant: only"
    assert got[3] == '{"role":"system","content":"' + "s" * 2000 + '"}' and got[4] == '{"role":"user"}' and got[5] == '{"role":"tool"}'


def test_explicit_corrections_need_wording_and_an_own_source(spark):
    from tracewell.operators import lifecycle

    raw = [(1, "correction", "When  X", "do", 9000, ["local"]), (2, "correction", "when x", "other", 9000, ["local"]), (3, "correction", "when x", "do", 8499, ["local"]), (4, "correction", "when x", "do", 9000, ["advisor_finding"]), (5, "habit", "when x", "do", 9000, ["local"]), (6, "correction", "when y", "do", 9000, [None]), (7, "correction", "when z", "do", 9000, ["local"])]
    raw = spark.createDataFrame([(1, "u", i, k, c, b, bp, s, False) for i, k, c, b, bp, s in raw], "batch_id int, user_id string, pos int, kind string, condition string, behavior string, confidence_bp int, sources array<string>, repeated boolean")
    habits = spark.createDataFrame([("u", "WHEN X", "Do", 1, "active"), ("u", "when y", "do", 1, "active"), ("u", "when z", "do", -1, "active"), ("u", "when z", "do", 1, "disabled")], "user_id string, condition string, behavior string, polarity int, status string")
    got = {r.pos: (r.explicit_correction, r.evidence_stage) for r in lifecycle.normalised_output(raw, habits).collect()}
    assert {i for i, (e, _) in got.items() if e} == {1, 6} and got[1][1] == "reviewable" and got[2][1] == "collecting"


def test_json_forms_redacts(spark):
    """F5 of round 3: the redacted fields had been dropped from the query and its SQL."""
    import __spark_entry__ as entry

    got = entry.queries()["json_forms"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["event_id", "token", "note", "generation", "part", "prefix"]
    assert {(r.token, r.note, r.generation == str(r.event_id)) for r in got.collect()} == {("[REDACTED]", "mail [REDACTED]", True)}
