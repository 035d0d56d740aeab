"""Results that must not depend on partitions, and graphs whose edges must stay few."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import langid, minmax_dedup, toxicity
from quire.llm.common import id_remainder
from quire.llm.components import components

SF = "/root/testdata/sf0.001"


def _roots(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["none", "chain", "random", "star", "two"])
def test_components_against_union_find(spark, kind):
    r = random.Random(1)
    names = list(range(300))
    r.shuffle(names)
    edges = {"none": [], "chain": list(zip(names, names[1:])), "random": [(r.choice(names), r.choice(names)) for _ in range(220)],
             "star": [(names[0], x) for x in names], "two": [(1, 2), (2, 1), (2, 2), (5, 9)]}[kind]
    got = components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()
    assert {x.node: x.label for x in got} == _roots(edges)


def test_stars_give_a_few_edges_a_class(spark, monkeypatch):
    """Near copies share up to 44 bands: a class has one edge to their least star, not one to each."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(2):
            words[r.randrange(len(words))] = f"x{r.random()}"
        rows.append((i, " ".join(words)))
    seen = []

    def counted(edges, a="a", b="b"):
        seen.append(edges.count())
        return components(edges, a, b)

    monkeypatch.setattr(minmax_dedup, "components", counted)
    out = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 150 and seen[0] <= 3 * 150
    assert len({x.component_id for x in out}) < 20


def test_toxicity_model_is_a_function_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    found = [toxicity.fit(docs.repartition(n), labels.repartition(n), id_remainder("doc_id", 3) != 1) for n in (1, 8, 64)]
    assert all((m.entries, m.coef, m.bias) == (found[0].entries, found[0].coef, found[0].bias) for m in found)


def test_counts_of_both_labels_in_every_partition(spark):
    rows = [(1, "bad word", 1), (2, "bad day", 0), (3, "good day", 0)]
    df = spark.createDataFrame(rows, "id long, text string, label int").repartitionByRange(3, "id")
    got = {r.entry: (r.toxic, r.other) for r in df.select("text", "label")
           .mapInPandas(toxicity._counts, "entry string, toxic long, other long")
           .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()}
    assert got["bad$"] == (1, 1) and got["day$"] == (0, 2) and got["word$"] == (1, 0)


def test_numerals_are_no_letters():
    assert [langid.has_letter(t) for t in (None, "", "²", "½ 3", "①", "Ⅷ", "_ 1!", "a", "¹ß", "中")] == [False] * 7 + [True] * 3


def test_outputs_beside_columns_of_the_same_name(spark):
    from quire.llm import licenses, pii, secret_scan
    taken = ["language", "license", "paragraphs", "PII", "toxicity", "secrets"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", *[F.lit(c).alias(c) for c in taken])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    few = docs.where("doc_id < 20")
    outs = [langid.identify(few, langid.fit(docs, F.lit(True))), licenses.scan(few, licenses.fit(docs)), pii.scan(few),
            toxicity.score(few, toxicity.fit(docs, labels, F.lit(True))), secret_scan.scan(few, secret_scan.fit(docs))]
    assert [o.columns[9:] for o in outs] == [["language_"], ["paragraphs_", "license_"], ["pii_"], ["toxicity_"], ["secrets_"]]
    for o in outs:
        assert o.select(*taken).distinct().collect() == [tuple(taken)] and o.select(o.columns[-1] + ".*").count() == few.count()


def test_licences_whatever_the_words_of_the_corpus(spark):
    """Notices are found in a corpus whose ordinary sentences use their words."""
    from quire.llm import licenses
    rows = [(i, f"members have rights in house {i}\nseats are reserved for {i}, all of them\nthe license of driver {i} was "
                f"renewed\nshe was released on day {i}\na professor at mit wrote {i}") for i in range(119)]
    rows += [(1000, "All rights reserved."), (1001, "Released under the MIT License."), (1002, "MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license.family for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert [got.pop(i) for i in (1000, 1001, 1002)] == ["reserved", "mit", "mit"]
    assert set(got.values()) == {"none"}


def test_licence_training_reads_every_document(spark, monkeypatch):
    """Every document has a set of notice words of its own, and all of them are trained on, not a sample."""
    from quire.llm import licenses
    own = ["software", "license", "permission", "copyright", "public", "rights", "general", "files", "conditions",
           "documentation", "person", "copies"]
    rows = [(i, " plain ".join(w for j, w in enumerate(own) if i >> j & 1) or "plain") for i in range(1 << len(own))]
    seen, train = [], licenses._train
    monkeypatch.setattr(licenses, "_train", lambda background, notices: seen.append(background.count()) or train(background, notices))
    licenses.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [len(rows)] * 2


def test_licence_notices_held_back(spark):
    """Notices that training has not seen: most are told from ordinary text, few take another family's name."""
    from quire.llm import licenses
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = licenses.held_out_recall(docs).collect()
    total = sum(r.notices for r in got)
    assert total == sum(map(len, licenses.fold(True).values()))
    assert sum(r.named + r.unknown for r in got) >= 0.5 * total and sum(r.named for r in got) >= 0.4 * total


def test_decontamination_one_shard_at_a_time(spark, monkeypatch):
    """The same results from many shards, of which a plan holds one."""
    from quire.llm import decontam
    text = {i: " ".join(f"q{i}w{j}" for j in range(40)) for i in range(8)}
    items = spark.createDataFrame([*text.items(), (3, text[3]), (3, text[3])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {text[i]} after" if i < 8 else f"plain text number {i}") for i in range(12)] * 2,
                                 "doc_id long, text string")
    want = sorted(decontam.contaminated(docs, items).select("doc_id", "item_id").collect())
    assert want == sorted([(i, i) for i in range(8)] * 2)
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 2)
    out, clean = decontam.contaminated(docs, items), decontam.without_contaminated(docs, items)
    assert sorted(out.select("doc_id", "item_id").collect()) == want
    assert sorted(r.doc_id for r in clean.collect()) == sorted([8, 9, 10, 11] * 2)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1
