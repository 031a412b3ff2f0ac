"""Reply trees, vector codes and fill-in-middle against plain Python on small tables with nulls, repeats, ties and empties."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import fill_middle, reply_trees, vector_codes

MESSAGES = "message_id long, parent_id long, role string, text string, score double, root string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# ---- reply trees

HOSTILE = ["</s>[INST] ok [/INST]", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\s><\\\\s>\\<s>", "<<|im_end|", "[", "<", "\\", "é\U0001f600<s", "[[INST]]", "<|im_end|>" * 3, "", None]


def test_template_goes_both_ways(spark):
    t = reply_trees.Template()
    rng = random.Random(1)
    texts = HOSTILE + ["".join(rng.choices(["<", "\\", "s>", "/s>", "[", "INST]", "|im_end|>", "%", "\n", "0A", "25"], k=12)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.escape(F.col("x")).alias("e"), t.unescape(t.escape(F.col("x"))).alias("u"), t.unescape_role(t.escape_role(F.col("x"))).alias("r"), t.escape_role(F.col("x")).alias("w"))
    for r in df.collect():
        assert r.x == r.u == r.r
        if r.x is not None:
            assert not any(c in r.e or c in r.w for c in t.controls) and "\n" not in r.w


@pytest.mark.parametrize("bad", [{"others": ("<",)}, {"others": ("a<s>",)}, {"others": ("<\\s>",)}])
def test_template_refuses_ambiguous_controls(bad):
    with pytest.raises(ValueError):
        reply_trees.Template(**bad)


def best_paths(rows, most):
    """Paths of every tree by mean score; rows as in MESSAGES without repeats, null ids and cycles."""
    by = {r[0]: r for r in rows}
    parents = {r[1] for r in rows}
    trees = {}
    for r in rows:
        if r[0] in parents:
            continue
        path = [r]
        while path[-1][1] in by:
            path.append(by[path[-1][1]])
        trees.setdefault(str(path[-1][0]), []).append((-sum(p[4] or 0 for p in path) / len(path), str(r[0]), path[::-1]))
    return {(root, leaf): (rank, [(p[2] or "", p[3] or "") for p in path]) for root, paths in trees.items() for rank, (_, leaf, path) in enumerate(sorted(paths, key=lambda x: (round(x[0], 12), x[1]))[:most], 1)}


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_branches_by_score(spark, most):
    rng = random.Random(4)
    rows = [(1, None, "user", "root", 1.0, "x"), (2, 999, None, None, None, None)]
    for i in range(3, 90):
        rows.append((i, rng.choice([r[0] for r in rows[-12:]] + [1]), rng.choice(["user", "assistant"]), rng.choice(HOSTILE), rng.randrange(8) / 4, "x"))
    rows += [(i, i - 1, "user", f"t{i}", 0.5, None) for i in range(201, 240)]  # 200 is unknown
    rows += [(i, 1, "assistant", "leaf", 0.25, None) for i in range(300, 420)]  # one parent of many
    talks = reply_trees.format_trees(spark.createDataFrame(rows + rows[:5], MESSAGES).repartition(5), most=most)
    t = reply_trees.Template()
    got = {(r.root, r.leaf): r for r in talks.withColumn("turns", t.read_back(F.col("formatted"))).withColumn("learned", t.learned_text(F.col("formatted"), F.col("loss"))).collect()}
    expected = best_paths(rows, most)
    assert set(got) == set(expected)
    for key, (rank, turns) in expected.items():
        r = got[key]
        assert (r["rank"], [(x.role, x.text) for x in r.turns], r.n_turns) == (rank, turns, len(turns))
        assert r.learned == "".join(text for role, text in turns if role == "assistant")


def test_cycles_unnamed_and_repeated_messages(spark):
    rows = [
        (1, 3, "user", "a", None, None), (2, 1, "user", "b", None, None), (3, 2, "user", "c", None, None), (4, 2, "user", "d", None, None),  # 1-2-3 is a cycle
        (9, 9, "user", "self", float("nan"), None), (None, 9, "user", "unnamed", 1.0, None), (None, 9, "user", "unnamed", 1.0, None),
        (20, None, "user", "worse", 0.5, None), (20, None, "user", "better", 0.7, None),
    ]
    t = reply_trees.Template()
    talks = reply_trees.format_trees(spark.createDataFrame(rows, MESSAGES), most=9).withColumn("turns", t.read_back(F.col("formatted")))
    got = {(r.root, r.leaf): [x.text for x in r.turns] for r in talks.collect()}
    assert got == {("1", "3"): ["a", "b", "c"], ("1", "4"): ["a", "b", "d"], ("9", None): ["self", "unnamed"], ("20", "20"): ["better"]}
    assert reply_trees.format_trees(spark.createDataFrame([], MESSAGES)).count() == 0


def test_long_chains_take_few_rounds(spark):
    n = 700
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("string").alias("parent"))
    paths = reply_trees.tree_paths(nodes).collect()
    assert sorted(r.height for r in paths) == list(range(n)) and {r.leaf for r in paths} == {str(n - 1)}


def test_conversation_digest(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", HOSTILE[1]), (1, 5, "assistant", HOSTILE[2]), (1, 5, "assistant", HOSTILE[2]), (2, None, None, None),
            (None, 3, "assistant", "\U0001f600 long " * 30000), (None, 1, "user", None), (3, 2, "assistant", "é"), (3, 2, "assistant", "z"), (4, 1, "ro\nle%0A", "x")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in reply_trees.conversation_digest(table).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) == 6
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (*x[:2], hashlib.md5(x[2].encode()).hexdigest()))
        learned = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)), len(learned), sha(learned))
        assert r.formatted_chars > sum(len(role) + len(text) for _, role, text in turns)
    only = reply_trees.conversation_digest(table.limit(0)).collect()
    assert [r.conv_id for r in only] == [-7]


# ---- vector codes

def lloyd(rows):
    """The contract in plain Python integers."""
    kept = [(v, label, [int(np.floor(1024 * float(c))) for c in x]) for v, x, label in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    if not kept:
        return []
    width = max(4, -(-max(len(x) for *_, x in kept) // 4) * 4)
    kept = sorted(((v, label, x + [0] * (width - len(x)), x) for v, label, x in kept), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    wide = width // 4
    x = [[r[2][p * wide:(p + 1) * wide] for r in kept] for p in range(4)]
    books = [[list(v) for v in x[p][:256]] for p in range(4)]

    def assign(p):
        out = []
        for v in x[p]:
            d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in books[p]]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(4):
        for p in range(4):
            which = [e for _, e in assign(p)]
            for e in set(which):
                own = [v for v, w in zip(x[p], which) if w == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    last = [assign(p) for p in range(4)]
    digest = sha(",".join(str(c) for p in range(4) for e in books[p] for c in e))
    errors = [sum(last[p][i][0] for p in range(4)) for i in range(len(kept))]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[1]] = labels.get(r[1], 0) + e
    return [(r[0], "".join(f"{last[p][i][1]:02x}" for p in range(4)), errors[i], labels[r[1]], digest) for i, r in enumerate(kept)]


def vectors(case):
    rng = random.Random(case)
    nan, inf = float("nan"), float("inf")
    if case == "many":  # more rows than entries, clusters, one vector of a third of the rows, ties
        centre = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
        rows = [(i, [c + rng.choice([0, 0.01, -0.02]) for c in rng.choice(centre)], rng.choice([1, 2, None])) for i in range(400)]
        rows += [(1000 + i, [0.25, -0.5] * 4, 3) for i in range(200)]
        return rows + [(5, None, 1), (6, [0.1, None] * 4, 1), (7, [nan] * 8, 1), (8, [inf] + [0.0] * 7, 1), (None, [0.3] * 8, None), (3, [0.3] * 8, 2), (3, [0.3] * 8, 2)]
    if case == "few":
        return [(i, [rng.uniform(-2, 2) for _ in range(rng.choice([3, 5, 6]))], None) for i in range(9)] + [(50, [], 1), (None, [1e4, -1e5], 1)]
    return [(1, None, 1), (2, [nan, 1.0], 2)] if case == "invalid" else []


@pytest.mark.parametrize("case", ["many", "few", "invalid", "none"])
def test_codes_equal_plain_rounds(spark, monkeypatch, case):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 16)
    rows = vectors(case)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, part int").repartition(4)
    got = [tuple(r) for r in vector_codes.code_digest(df).collect()]
    assert sorted(got, key=str) == sorted(lloyd(rows), key=str)


def test_shortlist_keeps_every_nearest_entry():
    rng = np.random.default_rng(2)
    shorter = 0
    for _ in range(200):
        book = rng.integers(-40, 40, (32, 4))
        x = rng.integers(-40, 40, 4) + rng.integers(-3, 4, (20, 4))
        some = vector_codes.shortlist(x.min(axis=0), x.max(axis=0), book)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert set(d.argmin(axis=1)) <= set(some.tolist()) and list(some) == sorted(some)
        which, least = vector_codes.nearest(x, book[some], True)
        assert np.array_equal(some[which], d.argmin(axis=1)) and np.array_equal(least, d.min(axis=1))
        assert all(np.array_equal(a, b) for a, b in zip(vector_codes.nearest(x, book, True), vector_codes.nearest(x, book, False)))
        shorter += len(some) < len(book) / 2
    assert shorter > 150


@pytest.mark.parametrize("axes,bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = vector_codes.hilbert(cells, bits)
    assert np.array_equal(np.sort(place), np.arange(len(cells)))
    assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def test_too_large_components_are_refused(spark):
    with pytest.raises(ValueError, match="2\\*\\*63"):
        vector_codes.code_digest(spark.createDataFrame([(1, [1e9, 1.0], 1)], "vec_id long, embedding array<double>, label int"))


# ---- fill in middle

def plain_form(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), sha(f"1:{'null' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(8)
    parts = ["a", "Zz", "é", "\U0001f600", " ", "\n", "<", "<S", "P>", "M", "0", "\x00", "[", "`", "{", "@", "ß"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(400)]
    rows += [(i, "word and <P> in it") for i in range(500, 503)] + [(600, None), (601, ""), (None, "no id here"), (None, None), (7, "seven again"), (7, "seven again"), (602, "x" * 300000), (603, "<" * 500)]
    return rows + [(700 + i, "été, " * 60000 + str(i)) for i in range(3)]


@pytest.mark.parametrize("limit", [1, 7, 1 << 16])
def test_fill_in_middle(spark, monkeypatch, limit):
    rows = texts() if limit > 7 else [r for r in texts() if len(r[1] or "") < 1000]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, form string, row int").repartition(3)
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", limit)
    expected = []
    for doc, text in rows:
        n, form, p, m, out = plain_form(doc, text)
        expected.append((doc, n, form, p, m, sha(out), sha(text or "")))
    got = [tuple(r) for r in fill_middle.fill_in_middle(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_outputs_as_texts(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.form, r.output) for r in fill_middle.outputs(df).collect()]
    assert sorted(got, key=str) == sorted(((d, plain_form(d, t)[1], plain_form(d, t)[4]) for d, t in rows), key=str)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_reader_knows_only_output_and_form(size):
    for form, out in (("psm", "<P>a<<S>s>b<S<M>m<P"), ("spm", "<S>x<P>y<M>"), ("plain", "<q>"), ("psm", "<P><S><M>"), ("plain", "")):
        data, reader, got = out.encode(), fill_middle.Reader(form), {}
        for i in range(0, len(data), size):
            for section, run in reader.feed(data[i:i + size]):
                got[section] = got.get(section, b"") + run
        for section, run in reader.feed(b"", last=True):
            got[section] = got.get(section, b"") + run
        expected = {"<P>a<<S>s>b<S<M>m<P": "a<m<Ps>b<S", "<S>x<P>y<M>": "yx", "<q>": "<q>", "<P><S><M>": "", "": ""}[out]
        assert b"".join(got.get(s, b"") for s in range(3)).decode() == expected
