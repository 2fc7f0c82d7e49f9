from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import text as T
from veilspan.operators import redact as R
from veilspan.operators import spans as S
from veilspan.operators import tokens as K

SPANS = "id long, spans array<struct<label:string,span_start:bigint,span_end:bigint>>"


def greedy(spans, key):
    at, kept = 0, []
    for s in sorted(spans, key=key):
        if s[1] >= at and s[2] > s[1]:
            kept.append(s)
            at = s[2]
    return kept


def cases(n, seed):
    rng = random.Random(seed)
    return [(k, [(rng.choice("abc"), a := rng.randrange(12), a + rng.randrange(5)) for _ in range(rng.randrange(7))]) for k in range(n)]


def test_offsets_count_code_points(spark):
    texts = ["a😀 b@x.io c@y.org", "", "no match", "😀b@x.io", "é b@x.io é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = "[a-z]+@[a-z]+\\.[a-z]+"
    for r in df.select("text", T.match_offsets(F.col("text"), pattern).alias("m")).collect():
        assert [(m.span_start, m.span_end) for m in r.m] == [m.span() for m in re.finditer(pattern, r.text)]


def test_greedy_choices_match_brute_force(spark):
    rows = cases(300, 1)
    df = spark.createDataFrame(rows, SPANS)
    out = df.select("id", S.select_non_overlapping(F.col("spans")).alias("a"), S.discard_overlaps_by_label(F.col("spans")).alias("b")).collect()
    want = dict(rows)
    for r in out:
        spans = want[r.id]
        assert [tuple(x) for x in r.a] == greedy(spans, lambda s: (s[1], s[1] - s[2], s[0]))
        each = [s for label in "abc" for s in greedy([s for s in spans if s[0] == label], lambda s: (s[1], s[1] - s[2]))]
        assert sorted(map(tuple, r.b)) == sorted(each)


def test_stable_choice_keeps_input_order_on_ties(spark):
    df = spark.createDataFrame([(1, [("z", 0, 3), ("a", 0, 3), ("b", 3, 3)])], SPANS)
    got = df.select(S.discard_overlaps_stable(F.col("spans")).alias("s")).first().s
    assert [tuple(x) for x in got] == [("z", 0, 3), ("b", 3, 3)]


def test_trimming_takes_unicode_spaces(spark):
    text = "　 ab\x85\x1c​"
    df = spark.createDataFrame([(1, text, [("a", 0, len(text)), ("b", 0, 2)])], "id long, text string, spans array<struct<label:string,span_start:bigint,span_end:bigint>>")
    got = df.select(S.trim_spans(F.col("text"), F.col("spans")).alias("s")).first().s
    stripped = text.strip()
    at = text.index(stripped)
    assert [tuple(x) for x in got] == [("a", at, at + len(stripped))]


def machine(tags):
    """The tolerant state machine over (index, boundary, label)."""
    out, current = [], None

    def close():
        nonlocal current
        if current:
            out.append((current[0], current[1], current[2] + 1))
        current = None

    for i, b, label in tags:
        if current and i != current[2] + 1:
            close()
        if b == "S":
            close()
            out.append((label, i, i + 1))
        elif b == "B":
            close()
            current = [label, i, i]
        elif b in "IE":
            if current and current[0] == label:
                current[2] = i
            else:
                close()
                current = [label, i, i]
            if b == "E":
                close()
    close()
    return out


def test_islands_match_state_machine(spark):
    rng, rows, want = random.Random(5), [], {}
    for d in range(200):
        tags = [(i, rng.choice("BIES"), rng.choice("xy")) for i in range(10) if rng.random() < 0.8]
        rows += [(d, i, b, label) for i, b, label in tags]
        want[d] = sorted(machine(tags))
    out = S.tags_to_spans(spark.createDataFrame(rows, "doc_id long, token_idx long, boundary string, label string")).collect()
    got = {d: [] for d in want}
    for r in out:
        got[r.doc_id].append((r.label, r.token_start, r.token_end))
    assert {d: sorted(v) for d, v in got.items()} == want


def test_token_labels_prefer_overlap_then_earlier(spark):
    df = spark.createDataFrame([(1, "ab cdef gh")], "doc_id long, text string")
    tokens = K.tokenize(df)
    spans = spark.createDataFrame([(1, "x", 0, 5), (1, "y", 5, 10)], "doc_id long, label string, span_start long, span_end long")
    got = {r.token_idx: (r.boundary, r.label) for r in K.label_tokens(tokens, spans).collect()}
    assert got == {0: ("B", "x"), 1: ("E", "x"), 2: ("S", "y")}


def test_tokens_and_windows(spark):
    df = spark.createDataFrame([(1, "Ab, é😀 9"), (2, ""), (3, None)], "doc_id long, text string")
    rows = sorted(K.tokenize(df).collect())
    assert [(r.token, r.char_start, r.char_end) for r in rows] == [("Ab", 0, 2), (",", 2, 3), ("é", 4, 5), ("😀", 5, 6), ("9", 7, 8)]
    assert [r.n_tokens for r in K.window_sizes(K.tokenize(df), 2).orderBy("window_id").collect()] == [2, 2, 1]
    with pytest.raises(ValueError):
        K.windows(df, 0)


def test_split_characters_are_covered_by_each_token():
    assert [x.tolist() for x in K.char_ranges([1, 2, 2, 1], "a😀b")] == [[0, 1, 1, 2], [1, 2, 2, 3]]
    with pytest.raises(ValueError):
        K.char_ranges([9], "ab")


def test_redaction(spark):
    text = "Mail jane.doe@example.com or +1 (555) 123-4567 now"
    df = spark.createDataFrame([(text,), (None,), ("",), ("   ",)], "text string")
    rows = {r.text: r for r in R.redact(df).collect()}
    assert rows[text].redacted_text == "Mail <PRIVATE_EMAIL> or <PRIVATE_PHONE> now" and rows[text].span_count == 2
    assert rows[None].redacted_text is None and rows[""].redacted_text == "" and rows["   "].span_count == 0
    collapsed = R.redact(df, mode="redacted").where(F.col("text") == text).first()
    assert collapsed.redacted_text == "Mail <REDACTED> or <REDACTED> now" and collapsed.detected_spans[0].label == "redacted"
    with pytest.raises(ValueError):
        R.Redactor().with_mode("other")


def test_result_json_and_warning(spark):
    import json

    df = spark.createDataFrame([("a b@x.io", "a b@x.io"), ("q", "a b@x.io")], "text string, decoded string")
    out = [json.loads(r.result) for r in R.Redactor().results(df, decoded="decoded").orderBy("text").collect()]
    assert "warning" not in out[0] and out[1]["warning"] == T.MISMATCH
    assert out[0]["summary"] == {"output_mode": "typed", "span_count": 1, "by_label": {"private_email": 1}, "decoded_mismatch": False}
    assert out[0]["detected_spans"] == [{"label": "private_email", "start": 2, "end": 8, "text": "b@x.io", "placeholder": "<PRIVATE_EMAIL>"}]


def test_scalars(spark):
    df = spark.createDataFrame([(3725.9, 0.12345, "abc", "abd")], "s double, m double, a string, b string")
    r = df.select(T.format_duration(F.col("s")), T.format_metric(F.col("m")), T.format_metric(F.lit(None).cast("double")), T.first_mismatch(F.col("a"), F.col("b")), T.first_mismatch(F.col("a"), F.col("a")), T.safe_ratio(F.lit(1), F.lit(0))).first()
    assert tuple(r) == ("01:02:05", "0.1235", "-", 2, None, None) or tuple(r) == ("01:02:05", "0.1234", "-", 2, None, None)


@pytest.mark.parametrize("limit", [3, 12, 80])
def test_snippets_escape_as_python_does(spark, limit):
    texts = ["", "plain", "tab\tnew\nback\\slash\r", "é€\x01\x7f\xa0", "\U0001f600" * 5, "x" * 100, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for k, got in rows.select("k", T.snippet(F.col("t"), limit)).collect():
        if texts[k] is None:
            assert got is None
            continue
        whole = texts[k].encode("unicode_escape").decode()
        assert got == (whole if len(whole) <= limit else whole[:limit] if limit <= 3 else whole[: limit - 3] + "...")


def test_tokens_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (None, " x"), (None, None)], "k long, text string").coalesce(1)
    rows = sorted(tuple(r) for r in K.tokenize(df, "k", surface=False).collect() if r.k)
    assert rows == sorted([(1, 0, 0, 2), (1, 1, 3, 5)] * 2)
    assert [tuple(r) for r in K.tokenize(df, "k").where("k is null").collect()] == [(None, 0, "x", 1, 2)]
    assert "Exchange" not in K.tokenize(df, "k")._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_cut_as_short_ones(spark):
    text = "".join(f"é{k} a@b{k}.io 😀\n" for k in range(2000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in R.redact(df).collect()}
    assert rows[1].redacted_text == re.sub(r"a@b\d+\.io", "<PRIVATE_EMAIL>", text) and rows[1].span_count == 2000
    assert (rows[2].redacted_text, rows[3].redacted_text) == (None, "")
    long = R.spans_long(df, "doc_id", R.detect(F.col("text")), F.col("text")).collect()
    assert [r.surface for r in sorted(long, key=lambda r: r.span_start)] == re.findall(r"a@b\d+\.io", text)
    wide = F.array(F.struct(F.lit("x").alias("label"), F.lit(4990).cast("long").alias("span_start"), F.lit(7001).cast("long").alias("span_end")))
    got = df.where("doc_id = 1").select(T.splice(F.col("text"), wide, lambda s: F.lit("|")).alias("t")).first().t
    assert got == text[:4990] + "|" + text[7001:]


def test_tags_within_the_row_match_joins(spark):
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice(["ab", "c", "def.", "😀"]) for _ in range(rng.randrange(30)))) for k in range(40)]
    spans = []
    for _, t in texts:
        ends = [sorted(rng.sample(range(len(t) + 1), 2)) for _ in range(rng.randrange(4))] if len(t) > 1 else []
        spans.append([(rng.choice("XY"), a, b) for a, b in ends])
    df = spark.createDataFrame([(k, t, s) for (k, t), s in zip(texts, spans, strict=True)], f"doc_id long, text string, s array<{T.SPAN}>")
    got = {(r.doc_id, r.token_idx): r.tag for r in K.tag_tokens(df, {"tag": F.col("s")}).collect()}
    joined = K.label_tokens(K.tokenize(df), R.spans_long(df, "doc_id", F.col("s")))
    assert got == {(r.doc_id, r.token_idx): r.tag for r in joined.select("doc_id", "token_idx", K.tag(F.col("boundary"), F.col("label")).alias("tag")).collect()}
    few = K.tag_tokens(df, {"tag": F.col("s")}, background=False).collect()
    assert {(r.doc_id, r.token_idx): r.tag for r in few} == {k: v for k, v in got.items() if v != "O"}


def test_fragments_and_decoded_text():
    raw = "aé😀b".encode()
    parts, start, end = K.fragments([raw[:2], raw[2:5], raw[5:]])
    assert (parts, start.tolist(), end.tolist()) == (["a", "é", "😀b"], [0, 1, 2], [1, 2, 4])
    assert K.fragments([b"a", b"\xf0\x9f"])[0] == ["a", "�"] and K.fragments([])[0] == []
    text, start, end = K.decoded_text([raw[:2], raw[2:5], raw[5:]])
    assert (text, start.tolist(), end.tolist()) == ("aé😀b", [0, 1, 2], [2, 3, 4])
    with pytest.raises(ValueError):
        K.decoded_text([b"\xff\xff"])


def test_context_length():
    assert K.context_length({"default_n_ctx": 8}) == 4096 and K.context_length({"max_position_embeddings": 8}, accelerated=True) == 8
    assert K.context_length({}, override=5) == 5 and K.context_length({}, accelerated=True) == 4096
    for bad in (True, 0, "8"):
        with pytest.raises(ValueError):
            K.context_length({"default_n_ctx": bad}, accelerated=True)


def test_public_names():
    import veilspan

    assert veilspan.redact is R.redact and all(getattr(veilspan, n) for n in veilspan.__all__)
    with pytest.raises(AttributeError):
        veilspan.nothing
