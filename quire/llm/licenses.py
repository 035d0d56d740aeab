"""Operator 8: licence scan by a trained paragraph classifier (DataFrame functions only).

A paragraph is a line, or the lines between two without a letter or digit, taken
together, as notices are often wrapped.  Its features are the distinct words and
word pairs of the notices, save those of ``COMMON`` words only.  The model is a sparse
multinomial logistic regression (L1) over licence families and ``none``, trained on the
notices below against the paragraphs of the whole corpus that hold no distinctive pair:
every distinct set of their features is a row, which weighs as much as a notice, or less
where all rows would weigh more than ``BACKGROUND_WEIGHT``.  Distinctive are the word pairs of one family's notices alone,
without a word of ``COMMON``.

A paragraph is read only if it has an anchor: a word pair that only one family's
notices have (of a notice without a distinctive pair, any pair of its own family's
alone), however frequent its words are.  Its family counts if the probability
reaches the threshold and if a notice of that family confirms it: the paragraph
holds ``CONFIRM`` of the notice's word pairs, or of its distinctive ones.  Paragraphs
that are likelier a licence than not, but fail either test, are ``unknown``.
Wrapped lines count beside their single lines only for what no single line of
them tells.

The threshold is calibrated on what training has not seen: a model fitted without
every third notice of a family scores those notices and the background paragraphs
held back, and the threshold lies half-way between the highest probability of
a background paragraph and that which all but ``MISSED`` of the held-back notices
that the model knows at all reach.  ``held_out_recall`` reports their recall by family.

The scan of a document is one projection: no shuffle, and a text of any length is one
row.  Training shuffles the distinct sets of features and sums over them in as many
tasks as they fill.  Only model coefficients reach the driver.

Defined results: null and empty texts, and texts without an anchor, are
``none`` with score 0; of several families the most probable paragraph's
decides, ties by name; a row of ``docs`` gives a row of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import free_name
from quire.llm.notices import NOTICES
from quire.session import materialize

CONFIRM = 0.6
MIN_PROBABILITY, MAX_PROBABILITY = 0.5, 0.95    # bounds of the threshold
MISSED = 0.05
HELD_EVERY = 3
REG = 5e-4
NOTICE_WEIGHT = 50.0
BACKGROUND_WEIGHT = 10_000.0                    # of all background rows; a row weighs as much as a notice at most
DIGITS = 6                                      # of coefficients, so that the order of sums does not show
NONE, UNKNOWN = "none", "unknown"

# Fixed words that make no pair distinctive.
COMMON = set("a an the this that of to in on at by for from with without and or not is are be been has have you your may "
             "can it its any all as under into no use file work program version source code form forms free copy charge "
             "later terms subject either except modify".split())


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def pairs(own: Column) -> Column:
    """Word pairs of a word array."""
    return F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))),
                      F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def pairs_among(own: Column, wanted: list[str]) -> Column:
    """The word pairs of a word array that are ``wanted``; a pair is built only where a word may begin one and the next end it.

    ``own`` is looked into word by word: a variable of a lambda function, or it is made again for every word.
    """
    begin, end = (sorted({p.split()[i] for p in wanted}) for i in (0, 1))
    built = F.transform(own, lambda w, i: F.when(w.isin(begin) & F.get(own, i + 1).isin(end), F.concat_ws(" ", w, F.get(own, i + 1))))
    return F.filter(built, lambda p: p.isin(wanted))


def features(own: Column) -> Column:
    return F.array_distinct(F.concat(own, pairs(own)))


def words_of(text: str) -> list[str]:
    """Words of a notice, in order."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def pairs_of(text: str) -> list[str]:
    """Word pairs of a notice."""
    ws = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)})


def vocabulary(notices: dict[str, list[str]]) -> list[str]:
    """The words and word pairs of the notices that are not of common words only."""
    return sorted({x for ts in notices.values() for t in ts for x in (*words_of(t), *pairs_of(t))
                   if not set(x.split()) <= COMMON})


def distinctive(family: str, text: str, notices: dict[str, list[str]] = NOTICES, plain: bool = False) -> list[str]:
    """A notice's pairs that no other family's notices have and that hold no common word, nor only numbers.

    ``plain``: common words are no hindrance unless both words are.
    """
    others = {p for f, ts in notices.items() if f != family for t in ts for p in pairs_of(t)}
    return [p for p in pairs_of(text) if p not in others and not p.replace(" ", "").isdigit()
            and (not set(p.split()) <= COMMON if plain else not COMMON & set(p.split()))]


def anchor_pairs(notices: dict[str, list[str]]) -> list[str]:
    """The distinctive pairs of every notice, or its plain ones where it has none."""
    return sorted({p for f, ts in notices.items() for t in ts
                   for p in distinctive(f, t, notices) or distinctive(f, t, notices, plain=True)})


def blocks(text: Column) -> Column:
    """Stretches of several lines between those without a letter or digit."""
    return F.filter(F.split(text, r"\n(?=[^A-Za-z0-9\n]*\n)"),
                    lambda b: F.regexp_replace(b, r"^[^A-Za-z0-9]+", "").contains("\n"))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class Model:
    """Families (``none`` first), the known features with their weights per family, anchors, threshold and notices."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    anchors: list[str]
    threshold: float
    notices: dict[str, list[str]] = field(default_factory=lambda: NOTICES)


def rows_of(spark: SparkSession, notices: dict[str, list[str]]) -> DataFrame:
    """The notices as rows (family, paragraph)."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("paragraph")) for f, ts in notices.items() for t in ts]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def fold(held: bool) -> dict[str, list[str]]:
    """Every third notice of a family (``held``), or the others."""
    return {f: [t for i, t in enumerate(ts) if (i % HELD_EVERY == HELD_EVERY - 1) == held] for f, ts in NOTICES.items()}


def _background(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct sets of known features of all paragraphs without a distinctive pair: own (features), held."""
    telling_pairs = sorted({p for f, ts in NOTICES.items() for t in ts for p in distinctive(f, t)})
    known = vocabulary(NOTICES)
    single = [t for t in known if " " not in t]
    double = [t for t in known if " " in t]
    text = F.col(text_col)
    none = F.array().cast("array<string>")

    def own(ws: Column) -> Column:
        """Words are looked up one by one, and pairs are built only where a word of a known feature is."""
        kept = F.concat(F.filter(ws, lambda w: w.isin(single)), pairs_among(ws, double))
        return F.when(F.exists(ws, lambda w: w.isin(single)), F.array_sort(F.array_distinct(kept))).otherwise(none)

    # sets are made before they become rows, so that no filter on rows makes them again
    paragraphs = F.transform(F.concat(F.split(text, "\n"), blocks(text)), words)
    sets = F.transform(F.filter(paragraphs, lambda ws: F.size(ws) > 0), own)
    return (docs.select(F.explode(sets).alias("own"))
            .where(~F.exists("own", lambda x: x.isin(telling_pairs))).distinct()
            .select("own", (F.pmod(F.xxhash64("own"), F.lit(3)) == 0).alias("held")))


def _train(background: DataFrame, notices: dict[str, list[str]]) -> Model:
    """The regression over the notices and the background paragraphs that are not held back."""
    families = [NONE, *sorted(notices)]
    index = F.array(*[F.lit(f) for f in families])
    known = rows_of(background.sparkSession, notices).select("family", features(words(F.col("paragraph"))).alias("own"))
    plain = background.where("not held").select("own", F.lit(0.0).alias("label"))
    weight = min(NOTICE_WEIGHT, BACKGROUND_WEIGHT / max(plain.count(), 1))
    rows = (known.select("own", (F.array_position(index, F.col("family")) - 1).cast("double").alias("label"),
                         F.lit(NOTICE_WEIGHT).alias("weight"))
            .unionByName(plain.withColumn("weight", F.lit(weight))))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary(notices), inputCol="own", outputCol="x")
    vectors.setBinary(True)
    fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial",
                                regParam=REG, elasticNetParam=1.0, maxIter=60, standardization=False,
                                ).fit(vectors.transform(rows))
    matrix = fitted.coefficientMatrix.toArray().round(DIGITS)
    weights = {t: [float(v) for v in matrix[:, i]] for i, t in enumerate(vectors.vocabulary)
               if abs(matrix[:, i]).max() > 1e-6}
    return Model(families, weights, [float(b) for b in fitted.interceptVector.toArray().round(DIGITS)], anchor_pairs(notices),
                 MIN_PROBABILITY, notices)


def _calibrated(model: Model, background: DataFrame) -> float:
    """The threshold by the held-back notices and background paragraphs of a model that has seen neither."""
    families = model.families
    worst = background.where("held").select(
        F.max(F.array_max(F.slice(probabilities(F.col("own"), model), 2, len(families)))).alias("p")).first().p or 0.0
    own = F.element_at(probabilities(features(words(F.col("paragraph"))), model),
                       F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("int"))
    held = sorted(r.p for r in rows_of(background.sparkSession, fold(True)).select(own.alias("p")).collect()
                  if r.p >= MIN_PROBABILITY)
    reached = held[int(MISSED * len(held))] if held else MAX_PROBABILITY
    return max(MIN_PROBABILITY, min(MAX_PROBABILITY, (worst + max(worst, reached)) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the notices and on background paragraphs of ``docs``, which are written once for both trainings."""
    background = materialize(_background(docs, text_col), "licence-background")
    threshold = _calibrated(_train(background, fold(False)), background)
    model = _train(background, NOTICES)
    model.threshold = threshold
    return model


def held_out_recall(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By family: the notices held back, and how many of them a model of the others names rightly or as ``unknown``."""
    background = materialize(_background(docs, text_col), "licence-background")
    model = _train(background, fold(False))
    model.threshold = _calibrated(model, background)
    found = scan(rows_of(docs.sparkSession, fold(True)), model, "paragraph")
    return found.groupBy("family").agg(
        F.count(F.lit(1)).alias("notices"), F.count_if(F.col("license.family") == F.col("family")).alias("named"),
        F.count_if(F.col("license.family") == UNKNOWN).alias("unknown"))


def _kind(paragraph: Column, wrapped: bool) -> Column:
    return F.struct(F.lit(wrapped).alias("wrapped"), paragraph.alias("paragraph"))


def probabilities(own: Column, model: Model) -> Column:
    """Softmax over the families for an array of distinct features."""
    terms = sorted(model.weights)
    table = F.map_from_arrays(_strings(terms), F.array(*[_numbers(model.weights[t]) for t in terms]))
    logits = F.aggregate(F.array_intersect(own, _strings(terms)), _numbers(model.bias),
                         lambda acc, t: F.zip_with(acc, F.element_at(table, t), lambda a, b: a + b))
    powers = F.transform(logits, lambda z: F.exp(z))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, v: s + v))


def _similarity(own: Column, family: Column, model: Model) -> Column:
    """Greatest share of a notice's word pairs, or of its distinctive ones, among a paragraph's features."""
    out = F.lit(0.0)
    for f in model.families[1:]:
        shares = [F.size(F.array_intersect(own, _strings(ps))) / F.lit(float(len(ps)))
                  for t in model.notices[f] for ps in (pairs_of(t), distinctive(f, t, model.notices)) if ps]
        out = F.when(family == f, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
    return out


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with struct columns ``license`` (family, score, similarity, n_paragraphs) and ``paragraphs`` (or the next free names).

    ``paragraphs`` lists every paragraph with an anchor: whether it is of wrapped
    lines, number from 0 (among the lines, or the stretches of lines), family,
    score and similarity.
    """
    def anchored_by(ws: Column) -> Column:
        """Whether the words hold an anchor."""
        return F.size(pairs_among(ws, model.anchors)) > 0

    text = F.coalesce(F.col(text_col), F.lit(""))
    def numbered(parts: Column, wrapped: bool) -> Column:
        return F.transform(parts, lambda p, i: F.struct(F.lit(wrapped).alias("wrapped"), i.alias("n"),
                                                        words(p).alias("ws")))

    lines = F.concat(numbered(F.split(text, "\n"), False), numbered(blocks(text), True))
    # the words of the text are the variable of a lambda function, so that they are made once
    anchored = F.when(F.exists(F.array(words(text)), anchored_by), F.filter(lines, lambda x: anchored_by(x.ws)))
    none = F.array().cast("array<struct<wrapped:boolean,n:int,own:array<string>,p:array<double>>>")
    scored = F.coalesce(F.transform(anchored, lambda x: F.struct(
        x.wrapped.alias("wrapped"), x.n.alias("n"), features(x.ws).alias("own"), probabilities(features(x.ws), model).alias("p"))), none)

    names = F.array(*[F.lit(f) for f in model.families[1:]])

    def judged(x: Column) -> Column:
        top = F.array_max(F.slice(x.p, 2, len(model.families)))
        family = F.element_at(names, F.array_position(F.slice(x.p, 2, len(model.families)), top).cast("int"))
        return F.struct(x.wrapped.alias("wrapped"), x.n.alias("n"), x.own.alias("own"), family.alias("family"),
                        top.alias("score"), _similarity(x.own, family, model).alias("similarity"), F.element_at(x.p, 1).alias("p_none"))

    def decided(x: Column) -> Column:
        sure = (x.score >= model.threshold) & (x.similarity >= CONFIRM)
        family = F.when(sure, x.family).when(x.p_none < 0.5, F.lit(UNKNOWN)).otherwise(F.lit(NONE))
        return F.struct(x.wrapped.alias("wrapped"), x.n.alias("n"), x.own.alias("own"), family.alias("family"),
                        x.score.alias("score"), x.similarity.alias("similarity"))

    def counted(x: Column, found: Column) -> Column:
        """Of lines and what they are wrapped in, what tells more; a line where both tell as much."""
        def tells(y: Column, inner: Column, outer: Column, least: Column) -> Column:
            return (y.wrapped != x.wrapped) & least & (F.size(F.array_except(inner.own, outer.own)) == 0)
        return F.when(x.wrapped, ~F.exists(found, lambda y: tells(y, y, x, (y.family != UNKNOWN) | (x.family == UNKNOWN)))
                      ).otherwise(~F.exists(found, lambda y: tells(y, x, y, (y.family != UNKNOWN) & (x.family == UNKNOWN))))

    listed, out = free_name(docs, "paragraphs"), free_name(docs, "license")
    with_paragraphs = docs.withColumn(listed, F.transform(F.transform(scored, judged), decided))
    found = F.filter(listed, lambda x: x.family != NONE)
    hits = F.filter(found, lambda x: counted(x, found))
    best = F.array_max(F.transform(hits, lambda x: F.struct(
        (x.family != UNKNOWN).alias("sure"), x.score.alias("score"), x.family.alias("family"),
        x.similarity.alias("similarity"))))
    return with_paragraphs.withColumn(out, F.struct(
        F.coalesce(best.family, F.lit(NONE)).alias("family"), F.coalesce(best.score, F.lit(0.0)).alias("score"),
        F.coalesce(best.similarity, F.lit(0.0)).alias("similarity"), F.size(hits).alias("n_paragraphs"))
    ).withColumn(listed, F.transform(listed, lambda x: x.dropFields("own")))
