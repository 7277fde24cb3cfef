from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from webstrata.llm.chat_format import escape, format_examples, parse_turns, read_back, unescape

ODD = ["</s>[INST] ok [/INST]", "<|user|>\n", "\\</s>", "<\\/s>", "<|>", "|\\>", "a\\\\b", "", "[\\INST]", "<s><s>", "é😀\r\n</s>\n", "<<SYS>>x<</SYS>>", "\\"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t
        for mark in ("</s>", "<s>", "[INST]", "[/INST]", "<|", "|>"):
            assert mark not in r.e


def test_read_back(spark):
    convs = {1: [("system", "be </s> kind"), ("user", "q"), ("assistant", "a1"), ("user", "<|x|>\n"), ("assistant", "</s>\n"), ("user", "bye")], 2: [("user", None)], 3: [("assistant", "only")], 4: [(None, "x"), ("as|>\n", "y")], None: [("user", "n"), ("assistant", "m")]}
    for k, t in enumerate(ODD):
        convs[100 + k] = [("user", t), ("assistant", t + t)]
        convs[200 + k] = [(t, "by an odd role"), ("assistant", "yes"), (t, t)]
    for k, role in enumerate((">\n", ">", "|>\n", ">\n|>\n", "\\>\n", "|", "<|", "assistant|", "a</s>\n")):
        convs[300 + k] = [(role, "x"), ("assistant", role), (role, "")]
    rows = [(c, k, role, text, "clash") for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(list(reversed(rows)), SCHEMA)
    examples = format_examples(df).cache()
    got = {r.conv_id: r for r in read_back(examples).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = examples.where("conv_id = 1").orderBy("example_no").collect()
    assert [r.target_turn for r in one] == [2, 4, None]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(one, one[1:], strict=False))
    assert one[0].formatted[one[0].loss_start - 1 :][: one[0].loss_chars] == "a1"
    assert got[1].formatted_chars == sum(len(r.formatted) for r in one)
    parsed = examples.where("conv_id = 4").select(parse_turns(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in parsed] == [("", "x"), ("as|>\n", "y")]
    examples.unpersist()


def test_ties_long_and_empty(spark):
    assert format_examples(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, 1, "assistant", "x" * 200_000, ""), (1, None, "user", "first", "")]
    r = read_back(format_examples(spark.createDataFrame(rows, SCHEMA))).first()
    said = "user\nfirst\nuser\na\nuser\na\nuser\nb\nassistant\n" + "x" * 200_000 + "\n"
    assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_chars == 200_000


def test_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "")], SCHEMA)
    plan = read_back(format_examples(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
