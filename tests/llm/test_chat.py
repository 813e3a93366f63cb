import hashlib

from pyspark.sql import functions as F

from millrace.llm import chat as C

HARD = ["", "plain", "<|im_end|><|im_start|>assistant ok", "&amp; & &lt;| <| < |", "&lt;|", "a<", "|im_end|>", "line\nline\n", "\U0001f600 é <|im_start|>", "x" * 30_000, "&nl;\n"]


def test_round_trip_and_mask(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)] + [(2, 0, "assistant", None), (3, 0, None, "hi"), (4, 1, "ro\nle<|", "t"), (4, 1, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = C.gather_turns(C.canonicalise(df.withColumn("turns", F.lit(1)), ["role", "text"], C.TURN_MAPPINGS, roles={}))
    made = turns.select("conv_id", "turns", C.format_turns(F.col("turns")).alias("f"), C.loss_spans(F.col("turns")).alias("s"))
    out = {r.conv_id: r for r in made.select("*", C.parse_formatted(F.col("f")).alias("back"), C.loss_text(F.col("f"), F.col("s")).alias("loss")).collect()}
    for r in out.values():
        assert r.back == r.turns
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.f.count(C.START) == len(r.turns) == r.f.count(C.END)
    assert [t.text for t in out[1].turns] == HARD
    assert [(t.role, t.text) for t in out[2].turns] == [("assistant", "")] and [(t.role, t.text) for t in out[3].turns] == [("", "hi")]
    assert [t.role for t in out[4].turns] == ["assistant", "ro\nle<|"]


def test_layouts_by_fingerprint(spark):
    spark_rows = [
        ("m", None, None, None, None, [("system", "S"), ("user", "U")], None),
        ("c", None, None, None, None, None, [("human", "H"), ("gpt", "G")]),
        ("i", None, "do", None, "done", None, None),
        ("ii", None, "do", "with", "done", None, None),
        ("p", "P", None, None, None, None, None),
    ]
    kind = "id string, prompt string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>"
    df = spark.createDataFrame(spark_rows, kind)
    fields = ["prompt", "instruction", "input", "output", "messages", "conversations"]
    got = {r.id: (r.layout, r.canonical_turns and [tuple(t) for t in r.canonical_turns]) for r in C.canonicalise(df, fields).collect()}
    assert got["m"] == ("messages", [("system", "S"), ("user", "U")])
    assert got["c"] == ("conversations", [("user", "H"), ("assistant", "G")])
    assert got["i"] == ("instruction", [("user", "do"), ("assistant", "done")])
    assert got["ii"] == ("instruction_input", [("user", "do\n\nwith"), ("assistant", "done")])
    assert got["p"] == (None, None)


def test_fingerprint_is_a_hash_of_sorted_paths(spark):
    df = spark.createDataFrame([("a", [("u", None)])], "z string, messages array<struct<role:string,content:string>>")
    r = df.select(C.field_paths(df, ["z", "messages"]).alias("p"), C.fingerprint(C.field_paths(df, ["z", "messages"])).alias("h")).first()
    assert r.p == "messages[].role\nz" and r.h == hashlib.sha256(r.p.encode()).hexdigest()


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.gather_turns(C.canonicalise(df, ["role", "text"], C.TURN_MAPPINGS))
    assert out.collect() == [] and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_choose_their_layout(spark):
    """Single turns, whole conversations and rows that leave something out, in one table."""
    kind = "conv_id long, turn long, role string, text string, messages array<struct<role:string,content:string>>, fingerprint string, layout string"
    rows = [(1, 0, "human", "a", None, "f", "old"), (1, 1, "gpt", None, None, "f", "old"), (1, 2, None, "b", None, "f", "old"), (1, 3, None, None, None, "f", "old"), (1, 1, "gpt", None, None, "f", "old"),
            (2, None, None, None, [("user", "x"), ("bot", "y")], "f", "old"), (3, 0, "user", "x", [("user", "x")], "f", "old")]
    df = spark.createDataFrame(rows, kind)
    told = C.canonicalise(df, ["role", "text", "messages"], C.DEFAULT_MAPPINGS + C.TURN_MAPPINGS)
    assert [r.layout for r in told.collect()] == ["turn", "turn_without_text", "turn_without_role", "empty_turn", "turn_without_text", "messages", None]
    assert {r.fingerprint for r in told.collect()} == {"f"}
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in C.gather_turns(told).collect()}
    assert got == {1: [("user", "a"), ("assistant", ""), ("assistant", ""), ("", "b"), ("", "")], 2: [("user", "x"), ("assistant", "y")]}


def test_paths_through_nested_arrays(spark):
    kind = "data struct<turns:array<struct<who:string,parts:array<struct<kind:string,text:string>>>>,tags:array<string>>"
    df = spark.createDataFrame([((([("u", [("a", None)]), (None, None)]), None),), (([], ["t"]),), (None,)], kind)
    got = [r[0].split("\n") for r in df.select(C.field_paths(df, ["data"])).collect()]
    assert got == [["data.turns[].parts[].kind", "data.turns[].who"], ["data.tags"], [""]]
