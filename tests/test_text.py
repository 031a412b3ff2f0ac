"""Golden values for text rules and chunking, compared with plain Python where that is the definition."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import chunking as C
from loomwright.operators import dictionary as D


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_clean_lines(spark):
    text = (
        "Title line of the paper about pancreas\r\nPage 3 of 10\n图 1 说明文字很长很长很长很长很长\nFig. 2 caption of a figure\n1.2 3.4 5.6 7.8 9\nshort\n"
        "胰腺炎\n急性胰腺炎患者\nResults [1, 2-3] by (Smith et al. 2019) at http://x.y/z and a.b@c.org   end of it\n参考文献\nlast line that must not survive"
    )
    expected = "Title line of the paper about pancreas\n急性胰腺炎患者\nResults by at and end of it"
    assert one(spark, T.clean_lines(F.col("t")), t=text).replace("  ", " ") == expected
    assert one(spark, T.clean_lines(F.col("t")), t="") == ""


def test_control_and_graph_clean(spark):
    assert one(spark, T.normalize_control(F.col("t")), t=" a\r\n\x07b\t c ") == "a b c"
    assert one(spark, T.graph_clean(F.col("t")), t="it's  \"x\" 胰腺（1）® ok") == "its \"x\" 胰腺（1） ok"


def test_names(spark):
    assert one(spark, T.normalize_name(F.col("t")), t="　ＡＢ１　 轻度  认知 ") == "AB1 轻度 认知"
    valid = {"患者": False, "a": False, "12.5 - 3": False, "ab": True, "胰腺": True}
    for name, expected in valid.items():
        assert one(spark, T.is_valid_name(F.col("t")), t=name) is expected
    assert one(spark, T.resolve_entity_type(F.col("t")), t=" 药物 ") == "Medicine"
    assert one(spark, T.resolve_entity_type(F.col("t")), t="strange") == "Disease"
    assert one(spark, T.resolve_relation_type(F.col("t")), t="并发症") == "HAS_COMPLICATION"
    assert one(spark, T.resolve_relation_type(F.col("t")), t="") == "BELONGS_TO"


def test_questions(spark):
    assert one(spark, T.question_type(F.col("t")), t="什么是胰腺炎") == "what"
    assert one(spark, T.question_type(F.col("t")), t="This one") == "yes_no"
    assert one(spark, T.intent_fine(F.col("t")), t="胰腺炎有哪些症状") == "symptom"
    assert one(spark, T.intent_coarse(F.col("t")), t="看什么科") == "department_query"
    assert one(spark, T.intent_pattern(F.col("t")), t="高血压吃什么药") == "治疗查询"
    assert one(spark, F.array_join(T.query_keywords(F.col("t")), ","), t="胰腺炎的症状，症状有哪些？预防") == "胰腺炎的,症状,症状有哪,预防"
    assert one(spark, F.array_join(T.match_known_entities(F.col("t")), ","), t="糖尿病和高血压") == "糖尿病,高血压"
    assert one(spark, F.array_join(T.match_known_entities(F.col("t")), ","), t="得了胰腺炎") == "得了胰腺炎"
    assert one(spark, T.normalize_query(F.col("t")), t=" 什么是 胰腺炎？ a#b ") == "什么是 胰腺炎? ab"


def test_tags_and_durations(spark):
    assert one(spark, T.entity_tag_name(F.col("t")), t="百日咳[疾病]") == "百日咳"
    assert one(spark, T.entity_tag_type(F.col("t")), t="百日咳[疾病]") == "DISEASE"
    assert one(spark, T.entity_tag_type(F.col("t")), t="百日咳[药]") is None
    for ms in (0, 500, 1500, 2500, 59999, 60000, 75000, 93000, 105000, 69000, 123456789):
        expected = f"{ms/1000:.0f}秒" if ms < 60000 else f"{ms/60000:.1f}分钟"
        assert one(spark, T.duration_text(F.col("t").cast("bigint")), t=str(ms)) == expected


def test_steps(spark):
    rows = [([("标题", "一句。" + "长" * 65 + "！第三句"), ("标题", "再一句"), ("尾", "")],)]
    df = spark.createDataFrame(rows, "s array<struct<heading string, content string>>")
    steps = df.select(T.sections_to_steps(F.col("s")).alias("x")).first()["x"]
    assert steps == ["一句", "长" * 30, "长" * 30, "长" * 5, "第三句", "标题", "再一句"]
    long = spark.createDataFrame([([("h", "长" * 300)],)], "s array<struct<heading string, content string>>")
    assert len(long.select(T.sections_to_steps(F.col("s")).alias("x")).first()["x"]) == 10


def test_table_text(spark):
    df = spark.sql("select array(array(array('a', null), array('b', ' c ')), array(array('d')), cast(array() as array<array<string>>)) as t")
    assert df.select(T.table_to_text(F.col("t")).alias("x")).first()["x"] == "| a |  |\n| b | c |\n\n| d |"


def plain_sentence_blocks(text, size, overlap):
    text = text.strip()
    spans, last = [], 0
    for m in re.finditer(r"[。！？.?!\n]+", text):
        spans.append(text[last : m.end()])
        last = m.end()
    spans.append(text[last:])
    spans = [s for s in spans if s.strip()]
    out, i = [], 0
    while i < len(spans):
        j, total = i, 0
        while j < len(spans) and (j == i or total + len(spans[j]) <= size):
            total += len(spans[j])
            j += 1
        out.append("".join(spans[i:j]).strip())
        i = max(i + 1, j - overlap) if overlap else j
    return [b for b in out if b]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n。？", max_size=80), st.integers(1, 12), st.integers(0, 3))
def test_sentence_blocks(text, size, overlap):
    assert C.sentence_blocks(text, size, overlap) == plain_sentence_blocks(text, size, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=80), st.integers(1, 12))
def test_word_blocks(text, size):
    blocks = C.word_blocks(text, size)
    assert " ".join(blocks).split() == text.split()
    assert all(len(b) + 1 <= size or " " not in b for b in blocks)


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "0123456789abcde"), (3, "  "), (4, "0123456789abcdefghi")], "id int, text string")
    rows = {r["id"]: r["w"] for r in df.select("id", C.fixed_windows(F.col("text"), 10, 3).alias("w")).collect()}
    assert rows[1] == ["x" * 10] and rows[3] == []
    assert rows[2] == ["0123456789", "789abcde"]
    assert rows[4] == ["0123456789", "789abcdefg", "efghi"]
    all_overlap = df.filter("id = 2").select(C.fixed_windows(F.col("text"), 10, 99).alias("w")).first()["w"]
    assert len(all_overlap) == 6


def test_extraction_paragraphs():
    assert C.extraction_paragraphs("abc。defg！hi", 6) == ["abc。", "defg。", "hi。"]
    assert C.extraction_paragraphs("ab。cd", 6) == ["ab。cd。"]


def test_contains_join(spark):
    rows = [(1, "abc胰腺炎 the quick brown fox"), (2, "the"), (3, ""), (4, None), (5, "quick brown"), (6, "a  b\nthe quick  brown"), (7, "   "), (8, "x" * 5000 + " quick brown fox the")]
    wanted = ["胰", "the", "quick brown", "fox", "zz", "brown", "ab", "quick brown fox", " ", "  ", "k b", "c胰腺炎 t", "he quick br", "b\nthe", "xx", " the ", "the quick zz fox", "", None]
    texts = spark.createDataFrame(rows, "id int, text string")
    names = spark.createDataFrame([(n, i) for i, n in enumerate(wanted)] + [("the", 99)], "name string, tag int")
    got = sorted((r["id"], r["name"], r["tag"]) for r in D.contains_join(texts, names, "id", "text").collect())
    tagged = [*zip(wanted, range(len(wanted))), ("the", 99)]
    assert got == sorted((i, n, tag) for i, t in rows if t for n, tag in tagged if n and n in t)
    assert D.contains_join(texts, names.limit(0), "id", "text").count() == D.contains_join(texts.limit(0), names, "id", "text").count() == 0


def test_chunk_table_function(spark):
    C.register_chunk_function(spark)
    spark.createDataFrame([(1, "one two three"), (2, None)], "id int, text string").createOrReplaceTempView("chunk_docs")
    rows = spark.sql("select d.id, c.chunk_index, c.chunk from chunk_docs d, lateral chunk_text(d.text, 'words', 8) c order by 1, 2").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "one two"), (1, 1, "three")]
