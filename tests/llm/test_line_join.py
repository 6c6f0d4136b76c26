import collections
import os

from pyspark.sql import functions as F

from innkeep.llm import line_join
from innkeep.llm.line_join import dedup_lines, line_counts

LOW = -(1 << 63)


def brute(docs, num=80, den=100):
    """Removed lines of each row (by place), comparing every line with all earlier ones that share a word."""
    rows = sorted(
        ((r.doc_id if r.doc_id is not None else LOW, k, place, line) for place, r in enumerate(docs.collect()) for k, line in enumerate(r.text.split("\n") if r.text is not None else [])),
        key=lambda r: r[:3],
    )
    lists, seen, sets, gone = collections.defaultdict(list), {}, [], collections.defaultdict(set)
    for _, k, place, line in rows:
        w = frozenset(line.encode().lower().split())
        if not w:
            continue
        shared = collections.Counter(j for x in w for j in lists[x])
        if any(den * c >= num * (len(w) + len(sets[j]) - c) for j, c in shared.items()):
            gone[place].add(k)
        if w not in seen:
            seen[w] = len(sets)
            sets.append(w)
            for x in w:
                lists[x].append(seen[w])
    return gone


def check(df):
    df = df.coalesce(1)
    rows, gone = df.collect(), brute(df)
    want = []
    for place, r in enumerate(rows):
        lines = r.text.split("\n") if r.text is not None else []
        kept = [x for k, x in enumerate(lines) if k not in gone[place]]
        want.append((str(r.doc_id), len(lines), len(gone[place]), sum(map(len, kept))))
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_chars) for r in line_counts(df).collect()) == sorted(want)
    out = dedup_lines(df)
    assert out.columns == df.columns
    texts = [None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[p]) for p, r in enumerate(rows)]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, texts))
    return sum(map(len, gone.values()))


def test_equals_brute_force(docs):
    assert check(docs.select("doc_id", "text")) > 100


def test_odd_rows_and_families(spark, odd_docs):
    base = [f"w{i}" for i in range(30)]
    rows = [(100 + k, "\n".join(" ".join(c if j != (k + 3 * m) % 30 else f"e{k}_{m}" for j, c in enumerate(base)) for m in range(3)), None, None, 1, 2, "h") for k in range(25)]
    rows += [(None, "A b c d e\n\n  \nb c d e a", None, None, 1, 2, "h"), (5, "a  b c d\na b c d f\nÉ x", None, None, 1, 2, "h")]
    df = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))
    assert check(df) > 20
    assert line_counts(df.limit(0)).collect() == []


def test_lines_of_one_template_are_compared_with_a_few(spark, monkeypatch):
    """A common word list with one changing word: as many candidates as lines, not their square."""
    sizes = {}

    def noted(df, path):
        out = written(df, path)
        if path.endswith("-pairs"):
            sizes[path.rsplit("/", 1)[1]] = out.count()
        return out

    written = line_join.written
    monkeypatch.setattr(line_join, "written", noted)
    words = "the quick brown fox jumps over a lazy dog by noon"
    rows = [(i, "\n".join(f"{words} id{10 * i + j}" for j in range(10))) for i in range(200)]
    out = line_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert out.agg(F.sum("n_lines"), F.sum("n_removed")).first() == (2000, 1999)
    assert sum(sizes.values()) <= 2 * 2000


def test_removed_lines_still_match_later_ones(spark):
    """A chain: each line matches the one before it, the ends don't match each other."""
    words = [f"c{i}" for i in range(60)]
    rows = [(k, " ".join(words[k : k + 20])) for k in range(0, 40)]
    df = spark.createDataFrame(rows * 12 + [(100 + k, t) for k, t in rows], "doc_id long, text string")
    assert check(df) == 40 * 13 - 1


def test_long_lines_that_share_a_rare_word_are_no_candidates(spark, monkeypatch):
    """Lines of 150 words, too long for 64 parity bits, meet at a word that two of them share."""
    sizes = {}

    def noted(df, path):
        out = written(df, path)
        if path.endswith("-pairs"):
            sizes[path.rsplit("/", 1)[1]] = out.count()
        return out

    written = line_join.written
    monkeypatch.setattr(line_join, "written", noted)
    rows = [(i, " ".join([f"r{i // 2}"] + [f"w{i}x{j}" for j in range(29)] + [f"c{(7 * i + j * (1 + i % 11)) % 400}" for j in range(120)])) for i in range(400)]
    out = line_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert out.agg(F.sum("n_lines"), F.sum("n_removed")).first() == (400, 0)
    assert sum(sizes.values()) <= 40


def test_shuffle_files_go_with_the_step_that_wrote_them(spark, docs, monkeypatch):
    """What stays on disk beside the steps' own tables is counts of rows, some bytes a task."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in files if "/shuffle_" in f and f.endswith(".data") and os.path.exists(f)}

    def noted(df, path):
        out = written(df, path)
        left.append(sum(size for f, size in shuffled().items() if f not in before))
        return out

    left, before, written = [], shuffled(), line_join.written
    monkeypatch.setattr(line_join, "written", noted)
    line_counts(docs)
    assert len(left) > 10 and max(left) < 20_000


def test_case_is_folded_for_ascii_letters_only(spark):
    """Names of texts are equal exactly where the texts are, up to the case of ASCII letters."""
    texts = ["É A b", "é a B", "é a b", "ã a b", "㩀 a b", "É㩀", "é㩀", "×÷ß", "÷×ß", "ПРИВЕТ x", "привет X", "привет x", "İ", "i̇", "𐐀 Q", "𐐨 q", "𐐀 q", "A", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_join._low(F.col("t")).alias("name")).collect()
    fold = lambda t: t.encode().lower()
    for x in rows:
        for y in rows:
            assert (x.name == y.name) == (fold(x.t) == fold(y.t)), (x.t, y.t)
