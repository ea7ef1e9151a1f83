from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.functions import markdown as MD
from assayer.functions import text as T
from assayer.functions import values as V
from assayer.functions.verdicts import verdict


def one(spark, column, **values):
    """The column over one row of the values."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("", ""), ("   ", ""), ("A  b \nC ", "a b c"), ("Ünder 😀  x", "ünder 😀 x")],
)
def test_text_key(spark, given, want):
    assert one(spark, T.text_key(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("One. Two.", "One"), ("Only one.", "Only one."), ("", ""), ("  Ask? Yes", "Ask"), ("no end", "no end"), ("3.5 is it. x", "3.5 is it")],
)
def test_first_sentence(spark, given, want):
    assert one(spark, T.first_sentence(F.col("t")), t=given) == want


def test_summary_and_themes(spark):
    assert one(spark, T.summary(F.col("t"), 2), t=" A b. C! D? ") == "A b. C!"
    assert one(spark, T.themes(F.col("t")), t="a; b. ;c.d ;e;f;g") == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(
    ("given", "most", "want"),
    [("a b", 5, ["a b"]), ("exact", 5, ["exact"]), ("ab. cd.", 5, ["ab.", "cd."]), ("abcdefgh", 3, ["abc", "def", "gh."]), ("abcdefghi", 3, ["abc", "def", "ghi", "."]), ("a  \n b", 3, ["a b"]), ("....", 3, ["...", "."])],
)
def test_split_description(spark, given, most, want):
    assert one(spark, T.split_description(F.col("t"), most), t=given) == want


def test_small_text_expressions(spark):
    assert one(spark, T.truncate(F.col("t"), 5), t="abc def") == "abc…"
    assert one(spark, T.truncate(F.col("t"), 7), t="abc def") == "abc def"
    assert one(spark, T.escape_html(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert one(spark, T.strip_code_fence(F.col("t")), t="```JSON\n{}\n```") == "{}"
    assert one(spark, T.strip_code_fence(F.col("t")), t=" {} ") == "{}"
    assert [one(spark, T.safe_token(F.col("t")), t=x) for x in ("a b/c", "", "é")] == ["a_b_c", "item", "_"]
    assert one(spark, T.canonical_path(F.col("t")), t="x/y.z/doc.tar.md") == "x/y.z/doc.tar.txt"
    assert one(spark, T.flat_path(F.col("t")), t="x/y/a.txt") == "x__y__a.txt"
    assert [one(spark, T.suffix(F.col("t")), t=x) for x in ("a/b.TXT", "a/.hidden", "a.b/c")] == [".txt", "", ""]
    assert one(spark, T.normalise_newlines(F.col("t")), t="a\r\nb\rc​d﻿") == "a\nb\ncd"
    assert [one(spark, T.split_lines(F.col("t")), t=x) for x in ("a b\x0bc\n", "", "\n", "a\r\nb")] == [["a", "b", "c"], [], [""], ["a", "b"]]
    assert [one(spark, T.normalise_heading(F.col("t")), t=x) for x in ("#a", "########  b ", "##")] == ["# a", "###### b", "##"]
    assert [one(spark, T.is_table_row(F.col("t")), t=x) for x in ("|a|b|", "|a|", "||", "|||", "a|b|")] == [False if x in ("|a|", "||", "a|b|") else True for x in ("|a|b|", "|a|", "||", "|||", "a|b|")]
    assert [one(spark, T.normalise_mode(F.col("t")), t=x) for x in (" Multi_Hop", "all", "default")] == ["multi-hop", None, None]
    assert [one(spark, T.format_number(F.col("v")), v=x) for x in (2.0, 0.5, 1 / 3, 100.0)] == ["2", "0.5", "0.333333", "100"]
    assert one(spark, T.block_description(F.lit("figure"), F.lit(2), F.lit(None).cast("array<double>"), F.lit(" x "))) == "[block: figure on page 2; text=x]"


def test_contexts(spark):
    c = F.array(F.struct(F.lit("t1").alias("text"), F.lit("s").alias("source")), F.struct(F.lit("t2").alias("text"), F.lit("").alias("source")))
    assert one(spark, T.render_contexts(c)) == "[1] s\nt1\n\n[2]\nt2"
    assert one(spark, T.render_contexts(F.filter(c, lambda x: F.lit(False)))) == "(no retrieved contexts)"


def test_values(spark):
    assert one(spark, V.truthy(F.lit(None), F.lit(""), F.lit(0))) == "0"
    assert one(spark, V.id_list(F.array(F.lit("a"), F.lit(""), F.lit(None)))) == ["a"] and one(spark, V.id_list(F.lit(None).cast("array<string>"))) == []
    a, b = F.create_map(F.lit("k"), F.lit("1"), F.lit("l"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))
    assert one(spark, V.merge_maps(a, F.lit(None).cast("map<string,string>"), b)) == {"k": "3", "l": "2"}
    assert one(spark, V.drop_nulls(F.create_map(F.lit("k"), F.lit("1"), F.lit("l"), F.lit(None).cast("string")))) == {"k": "1"}
    assert [one(spark, V.binary_text(F.col("t")), t=x) for x in (" YES ", "0.5", "0.49", "nan", "fail", "what", "inf")] == [1, 1, 0, 0, 0, 0, 1]
    assert [one(spark, V.binary_number(F.col("v")), v=x) for x in (float("nan"), 0.5, 0.4)] == [0, 1, 0]
    assert one(spark, V.bbox(F.array(*map(F.lit, ("1", "2", "3", "4.5"))))) == [1, 2, 3, 4.5] and one(spark, V.bbox(F.array(F.lit("1"), F.lit("x"), F.lit("2"), F.lit("3")))) is None
    assert [one(spark, V.assertion_score(F.col("v")), v=x) for x in (7.0, 85.0, 100.0, 11.0, 0.0)] == [7, 9, 10, 1, 0]
    half, whole = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.divergence("Jensen-Shannon", half, whole)) == pytest.approx(0.3112781245) and one(spark, V.divergence("tvd", half, whole)) == 0.5
    with pytest.raises(ValueError):
        V.divergence("other", half, whole)
    assert one(spark, V.coverage(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b")))) == 0.5 and one(spark, V.coverage(F.array().cast("array<string>"), F.lit(None).cast("array<string>"))) == 1
    assert one(spark, V.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and one(spark, V.cosine(whole, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert V.cluster_count(5, 3) == 3 and V.cluster_count(0, 0) == 1
    assert one(spark, V.embedding_prefix("e5-small", F.lit("x"), True)) == "query: x" and one(spark, V.embedding_prefix("other", F.lit("x"), True)) == "x"


@pytest.mark.parametrize(
    ("raw", "value", "reason"),
    [
        ('{"correctness": 1, "reason": "r"}', 1.0, "r"),
        ('{"correctness": "no", "score": 1}', 0.0, '{"correctness": "no", "score": 1}'),
        ('{"correctness": null, "value": 1}', 0.0, '{"correctness": null, "value": 1}'),
        ('```json\n{"evaluation": true, "explanation": "e"}\n```', 1.0, "e"),
        ('so {"value": 0.6} there', 1.0, 'so {"value": 0.6} there'),
        ("[1]", 1.0, "[1]"),
        ("it is 0.9", 0.0, "it is 0.9"),
        ("I know it", 0.0, "I know it"),
        ("yes", 1.0, "yes"),
        ("yes, not no", 0.0, "yes, not no"),
        ("", 0.0, ""),
        (None, 0.0, ""),
    ],
)
def test_verdicts(spark, raw, value, reason):
    got = one(spark, verdict(F.col("t")), t=raw)
    assert (got["value"], got["reason"]) == (value, reason)


SAMPLE = "---\ntitle: 'A b'\n# c\nx: 1:2\n---\n\n\n#  Top\n\n\ntext  \n```py\na  \n\n\n~~~\n```\n|a|b|\n|-|-|\n ## Sub ##\n"


def rewrite(spark, text):
    return one(spark, MD.rewritten(F.col("t")), t=text).asDict()


def test_markdown_rewriting(spark):
    got = rewrite(spark, SAMPLE)
    assert got["frontmatter"] == {"title": "A b", "x": "1:2"} and got["title"] == "Top" and (got["headings"], got["table_rows"]) == (2, 2)
    assert got["text"] == "# Top\n\ntext\n```py\na\n\n\n~~~\n```\n|a|b|\n|-|-|\n## Sub ##\n"
    assert rewrite(spark, "---\nopen: yes\n")["frontmatter"] == {} and rewrite(spark, None)["text"] == ""
    assert rewrite(spark, "---\ntitle: T\n---\nplain")["title"] == "T"
    assert rewrite(spark, "---\na: 1\na: 2\n---\n")["frontmatter"] == {"a": "2"} and rewrite(spark, "---\n---\nx")["text"] == "x\n"
    assert rewrite(spark, "a\n\n```\nopen  \n\n\n  ~~~  \n")["text"] == "a\n\n```\nopen\n\n\n~~~\n"  # nothing closes it
    assert rewrite(spark, "#\n####### deep\r\n\ufeff \n \n\nend")["text"] == "#\n###### deep\n\nend\n" and rewrite(spark, " \n \n") == {"text": "", "title": None, "frontmatter": {}, "headings": 0, "table_rows": 0}
    long = rewrite(spark, "# a  \n\n\nb\n```\nx  \n```\n" * 20000)
    assert long["headings"] == 20000 and long["text"] == "# a\n\nb\n```\nx\n```\n" * 20000


def test_native_counters_agree_with_rewriting(spark):
    for t in (SAMPLE.split("---\n", 2)[2], "```\n# no\n~~~\n```\n# yes\n|a|b|", "~~~\n```\n# no\n~~~\n# yes", ""):
        got = one(spark, MD.counters(F.col("t")), t=t)
        want = rewrite(spark, t)
        assert (got["headings"], got["table_rows"]) == (want["headings"], want["table_rows"])


def test_chunks_cover_the_text(spark):
    text = "\n## h\n".join(" ".join(f"w{i}{j}" for j in range(60)) for i in range(12))
    got = MD.chunks(text, 200, 40)
    assert all(0 < len(c) <= 200 for c in got)
    words = text.split()
    seen = {w for c in got for w in c.split()}
    assert set(words) <= seen and MD.chunks("", 10, 2) == [] and MD.chunks("abcdefghij" * 3, 10, 0) == ["abcdefghij"] * 3
    tokens = lambda t: one(spark, MD.token_chunks(F.col("t"), 3, 1), t=t)
    assert tokens("a b c d e f g") == ["a b c", "c d e", "e f g"] and tokens("") == tokens(None) == tokens("  ") == [] and tokens(" x-y  ") == ["x-y"]
    with pytest.raises(ValueError):
        MD.chunks("a", 5, 5)
    with pytest.raises(ValueError):
        MD.token_chunks("a", 5, 5)


def test_chunks_share_whole_pieces():
    assert MD.chunks("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]  # a word with its blank is shared, as it fits
    assert MD.chunks("aa bb cc dd", 6, 2) == ["aa bb", "cc dd"]
    assert MD.chunks("ab\n\n" + "x" * 9 + "\n\ncd ef", 5, 0) == ["ab", "xxxx", "xxxxx", "cd", "ef"]
    assert MD.chunks("# a\nb\n## c\nd", 9, 0) == ["# a\nb", "## c\nd"] and MD.chunks("aaaa", 1, 0) == list("aaaa")
    assert MD.chunks("aaaa bbbb", 3, 0, (" ",)) == ["aaaa", "bbbb"]  # nothing cuts them
