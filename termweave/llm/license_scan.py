"""Licence scan: a trained paragraph classifier over sparse word bigrams.

A multinomial logistic regression, fitted on the driver on variants of the built-in notices, gives
each known bigram a weight per class.  The scan itself is DataFrame operations only: paragraphs are
tokenised, their distinct bigrams are equi-joined to the weight table, weights are summed per
paragraph, the calibrated softmax picks the class, and the bigrams found are compared with the
notices of that family.  Notices that run over several lines are looked for beside it: the known
bigrams of neighbouring lines are pooled over a stretch of words a quarter longer than the notice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import cut
from termweave.llm.license_texts import FAMILIES, ORDINARY, UNKNOWN

WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
STOP = frozenset("a all an and any are as at be been by can for from has have if in is it its may of on one or shall that the this to was with you your".split())
CLASSES = [*FAMILIES, "unknown", "none"]


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def bigrams(tokens: list[str]) -> set[str]:
    """Distinct pairs of neighbours, but for pairs of stop words."""
    return {f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if not (a in STOP and b in STOP)}


@dataclass
class LicenseModel:
    weights: dict[str, np.ndarray]  # bigram -> weight per class
    bias: np.ndarray
    temperature: float
    notices: dict[str, list[list[str]]]  # family -> the known bigrams of each notice


def _variants(text: str, rng: np.random.RandomState, n: int, filler: list[str]) -> list[list[str]]:
    """The words of a notice, of it in other surroundings, with a word lost, and of parts of long ones."""
    base = words(text)
    out = [base]
    for _ in range(n - 1):
        w = list(base)
        if len(w) > 14 and rng.rand() < 0.6:
            size = rng.randint(10, len(w) + 1)
            at = rng.randint(0, len(w) - size + 1)
            w = w[at : at + size]
        if len(w) > 5 and rng.rand() < 0.3:
            del w[rng.randint(len(w))]
        before, after = rng.randint(0, 12, 2)
        out.append([*rng.choice(filler, before), *w, *rng.choice(filler, after)])
    return out


def fit_license_model(variants: int = 24, seed: int = 3, strength: float = 2e-4, steps: int = 300) -> LicenseModel:
    """Fit and calibrate on variants of the notices; the size of the model depends on the notices alone."""
    rng = np.random.RandomState(seed)
    filler = sorted({w for t in ORDINARY for w in words(t)})
    rows: list[tuple[set[str], int]] = []
    for c, texts in enumerate([*FAMILIES.values(), UNKNOWN, ORDINARY]):
        for t in texts:
            rows += [(bigrams(w), c) for w in _variants(t, rng, variants, filler)]
    every = [w for texts in FAMILIES.values() for t in texts for w in words(t)]
    rows += [(bigrams(list(rng.choice(every, 25))), len(CLASSES) - 1) for _ in range(400)]  # words of notices in no order
    known = sorted({g for texts in [*FAMILIES.values(), UNKNOWN] for t in texts for g in bigrams(words(t))})
    column = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1), np.float32)
    x[:, -1] = 1
    for i, (grams, _) in enumerate(rows):
        for g in grams:
            if g in column:
                x[i, column[g]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[[c for _, c in rows]]
    share = y / y.sum(0)  # each class weighs the same
    held = rng.rand(len(rows)) < 0.2
    xt, yt, st = x[~held], y[~held], share[~held].sum(1, keepdims=True) / len(CLASSES)
    w = np.zeros((len(known) + 1, len(CLASSES)), np.float32)
    m = v = np.zeros_like(w)
    for k in range(1, steps + 1):  # Adam
        z = xt @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = xt.T @ ((p - yt) * st) + strength * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    z = x[held] @ w
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 4, 45):  # calibration: the temperature of least log loss on the rows held out
        q = z / t
        loss = float((np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - (q * y[held]).sum(1)).mean())
        if loss < best:
            best, temperature = loss, float(t)
    weights = {g: w[i].astype(float).round(6) for g, i in column.items()}
    notices = {f: [sorted(bigrams(words(t))) for t in texts] for f, texts in FAMILIES.items()}
    return LicenseModel(weights, w[-1].astype(float).round(6), temperature, notices)


#: A stretch of words as long as a notice and a quarter, in the scaled positions of :func:`_wrapped`.
STRETCH = 1_250_000


def _scores(model: LicenseModel, sums: list) -> tuple:
    """The logits as an array, and over an array column ``z`` of them the best class and its calibrated probability."""
    logits = F.array(*[(c + float(b)) / model.temperature for c, b in zip(sums, model.bias)])
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z - top))
    return logits, F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("z", top).cast("int")), 1.0 / total


def _wrapped(found: DataFrame, model: LicenseModel, names: list[str], least_probability: float, least_similarity: float) -> DataFrame:
    """row, doc_id, first, last (lines), family, p, similarity of the notices that run over several lines.

    ``found`` holds the known bigrams with their place; those that cross a line end are among them.
    """
    spark = found.sparkSession
    notices = [(i, f, g, len(n), max(2, len(words(t)))) for i, (f, t, n) in enumerate((f, t, n) for f, ts in FAMILIES.items() for t, n in zip(ts, model.notices[f])) for g in n]
    known = spark.createDataFrame(notices, "notice int, family string, gram string, size int, words int")
    key = ["row", "notice"]
    # Places are scaled by the notice's length, so that one range fits all notices; a gap between lines parts them.
    gap = F.count_if(F.col("gram").isNull()).over(Window.partitionBy("row").orderBy("pos"))
    hits = found.select("row", "doc_id", "pos", "line", "next_line", "gram", gap.alias("gap")).join(F.broadcast(known), "gram").withColumn("at", F.expr("(pos + gap * 1000000000L) * 1000000 div words"))
    ahead = Window.partitionBy(*key).orderBy("at").rangeBetween(0, STRETCH)
    hits = hits.select("row", "doc_id", "notice", "family", "size", "at", "pos", "line", F.size(F.collect_set("gram").over(ahead)).alias("n"), F.max("next_line").over(ahead).alias("last"), F.max("pos").over(ahead).alias("stop"))
    hits = hits.withColumn("similarity", F.col("n") / F.col("size")).where((F.col("similarity") >= least_similarity) & (F.col("last") > F.col("line")))
    before = Window.partitionBy(*key).orderBy("at").rangeBetween(-STRETCH, -1)
    after = Window.partitionBy(*key).orderBy("at").rangeBetween(0, STRETCH)
    # Of stretches that overlap the one that holds most, the last of equal ones: it begins with the notice.
    best = hits.withColumn("was", F.coalesce(F.max("n").over(before), F.lit(0))).withColumn("final", F.max(F.struct("n", "at")).over(after)["at"])
    best = best.where("n >= was and final = at").drop("was", "final")
    # All known bigrams of the stretch are classified together.
    inside = found.where("gram is not null").select("row", "gram", F.col("pos").alias("place"), *names)
    pooled = best.join(inside, "row").where("place between pos and stop").dropDuplicates(["row", "notice", "pos", "gram"])
    own = ["row", "doc_id", "notice", "family", "pos", "stop", "line", "last", "n", "similarity"]
    logits, guess, p = _scores(model, [F.col(n) for n in names])
    pooled = pooled.groupBy(*own).agg(*[F.sum(n).alias(n) for n in names]).withColumn("z", logits)
    pooled = pooled.select(*own, guess.alias("guess"), p.alias("p")).where((F.col("guess") == F.col("family")) & (F.col("p") >= least_probability))
    # One row for what several notices find in mostly the same words: that of most bigrams.
    other = pooled.select(F.col("row").alias("row2"), F.col("n").alias("n2"), F.col("notice").alias("notice2"), F.col("pos").alias("pos2"), F.col("stop").alias("stop2"))
    better = F.expr("row = row2 and 2 * (least(stop, stop2) - greatest(pos, pos2) + 1) > stop - pos + 1 and (n2 > n or n2 = n and notice2 < notice)")
    pooled = pooled.join(other, better, "left_anti")
    return pooled.select("row", "doc_id", F.col("line").alias("first"), "last", "family", "p", "similarity")


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, least_probability: float = 0.5, least_similarity: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph (line) that the model takes for a licence notice, and one per notice wrapped over lines.

    doc_id, paragraph (from 0), family, probability, similarity (share of the bigrams of the closest
    notice of the family), confirmed.  Family is unknown where the calibrated probability stays below
    ``least_probability`` or no notice is similar enough; confirmed says that a notice is.  A notice
    over several lines without an empty one between stands at its first line, in place of the
    unconfirmed rows of its lines; where a line of it is confirmed for the family by itself, that row
    stands for it.  Null and empty texts give no rows; repeated rows are reported as often as they
    occur; a null id is kept.
    """
    spark = docs.sparkSession
    model = fit_license_model() if model is None else model
    names = [f"w{i}" for i in range(len(CLASSES))]
    # A few thousand bigrams, whatever the corpus.
    table = spark.createDataFrame([(g, *map(float, w)) for g, w in model.weights.items()], ", ".join(["gram string", *(f"{n} double" for n in names)]))
    families = spark.createDataFrame([(f, [g for g in n if g]) for f, n in model.notices.items()], "family string, notices array<array<string>>")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    token = lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), i.alias("line")))
    rows = rows.select("doc_id", "row", F.flatten(F.transform(F.split(F.lower("t"), "\n"), token)).alias("w")).where("size(w) > 1")
    pair = lambda a, b: F.struct(F.when(b["line"] - a["line"] < 2, F.concat(a["w"], F.lit(" "), b["w"])).alias("gram"), a["line"].alias("line"), b["line"].alias("next_line"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), pair)
    grams = rows.select("doc_id", "row", F.posexplode(pairs).alias("pos", "g")).select("doc_id", "row", "pos", "g.*")
    # Few: the known ones, and the places of empty lines, which have no bigram.
    found = cut(grams.join(F.broadcast(table), "gram", "left").where("w0 is not null or gram is null"), "bigrams")
    # A line names a known bigram once: doubles are dropped where they meet, together with the sums.
    lines = found.where("line = next_line").groupBy("row", F.col("line").alias("paragraph"), "gram").agg(F.first("doc_id").alias("doc_id"), *[F.first(n).alias(n) for n in names])
    lines = lines.groupBy("row", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.collect_list("gram").alias("grams"), *[F.sum(n).alias(n) for n in names])

    logits, guess, p = _scores(model, [F.col(n) for n in names])
    scored = lines.select("doc_id", "row", "paragraph", "grams", logits.alias("z"))
    scored = scored.select("doc_id", "row", "paragraph", "grams", guess.alias("guess"), p.alias("p"))
    scored = scored.where("guess <> 'none'")
    near = scored.join(F.broadcast(families), scored["guess"] == families["family"], "left")
    shares = F.transform("notices", lambda n: F.size(F.array_intersect(n, "grams")) / F.size(n))
    near = near.withColumn("similarity", F.coalesce(F.array_max(shares), F.lit(0.0)))
    sure = (F.col("p") >= least_probability) & (F.col("similarity") >= least_similarity)
    near = near.select("row", "doc_id", "paragraph", F.when(sure, F.col("guess")).otherwise("unknown").alias("family"), "p", "similarity", sure.alias("confirmed"))

    wrapped = cut(_wrapped(found, model, names, least_probability, least_similarity), "wrapped")
    w, n = wrapped.alias("w"), near.alias("n")
    within = (F.col("n.row") == F.col("w.row")) & F.col("n.paragraph").between(F.col("w.first"), F.col("w.last"))
    alone = n.join(w, within & ~F.col("n.confirmed"), "left_anti").drop("row")
    over = w.join(n, within & F.col("n.confirmed") & (F.col("n.family") == F.col("w.family")), "left_anti")
    over = over.select("doc_id", F.col("first").alias("paragraph"), "family", "p", "similarity", F.lit(True).alias("confirmed"))
    out = alone.unionByName(over)
    return out.select("doc_id", "paragraph", "family", F.round("p", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")
