from collections import Counter

from tideframe.llm import quality


def brute_repeat(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})


def test_base_statistics(spark):
    long = "one two three four five six " * 30
    texts = ["", None, "a\nb\n\n\nb\n \n ", long, "x " * 9, "ünï cödé | # \x0b tail", "clean words that all differ from each other as prose would do", "words " * 30 + "z"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    rows = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert rows[i].n_words == len(words)
        assert rows[i].word_chars == sum(len(w.decode()) for w in words)
        assert rows[i].n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert rows[i].n_dup_lines == len(lines) - len(set(lines))
        assert rows[i].n_repeat_words == brute_repeat(t)
        assert not (rows[i].kept and rows[i].base_failed)
    assert rows[6].kept and not rows[3].kept and not rows[0].kept


def test_many_distinct_words_stay_exact():
    text = " ".join(f"w{i}" for i in range(20_000)) + " " + " ".join(f"w{i}" for i in range(100, 110))
    assert quality.n_repeat_words(quality.Document(text)) == brute_repeat(text)


def test_verdict_ignores_order_and_order_follows_rate(spark):
    assert quality.order([("symbol_ratio", 1e-6, 0.5), ("few_distinct_words", 1e-3, 0.5)])[0] == "symbol_ratio"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = quality.apply_rules(docs, ordered=list(quality.RULES)).orderBy("doc_id").collect()
    b = quality.apply_rules(docs, ordered=list(quality.RULES)[::-1]).orderBy("doc_id").collect()
    assert a == b


def test_empty_table(spark):
    assert quality.apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_keys_repeated_rows_and_filter(spark):
    good, bad = "clean words that all differ from each other as prose would do", "x"
    docs = spark.createDataFrame([(None, good, 1), (1, good, 2), (1, good, 2), (2, bad, 3), (3, None, 4)], "doc_id long, text string, n_words int")
    assert sorted((r.doc_id or 0, r.kept) for r in quality.apply_rules(docs).collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [1, 2, 2]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id for r in quality.apply_rules(table).collect() if r.kept}
    assert {r.doc_id for r in quality.keep_good(table).collect()} == want


def test_figures_that_are_owed_cost_rules_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    free = dict((r, s) for r, s, _ in quality.measure(docs, owed=quality.COUNTS))
    paid = dict((r, s) for r, s, _ in quality.measure(docs))
    assert free["duplicate_lines"] < paid["duplicate_lines"]
