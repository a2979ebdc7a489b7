"""Document quality by co-training: one classifier reads the text, another only the page's metadata.

Both start from the labelled rows. In each round each view labels the unlabelled documents it is sure of for the other
view, and both are fitted again. A last fold of the labelled rows calibrates the two views together, and the calibrated
pair scores every document. Features of all documents are computed once and kept as a table; fits are distributed.

Folds go by crc32(doc_id) mod 4: 0 and 1 train, 3 calibrates, 2 is held out.

Cases: a null text counts as empty, null metadata as a value of its own; labels that are null are unlabelled, and of
several labels for one doc_id the lowest counts; where a fold lacks one of the two labels, the share of label 1 is every
document's score; rows alike are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keeps, tidy, written
from .tokens import each

ROUNDS, SURE = 2, 0.98
#: Metadata values are hashed into this many sparse columns.
META_COLUMNS = 1 << 14
TEXT_FEATURES = ("log_words", "word_length", "letters", "digits", "blanks", "symbols", "upper", "distinct", "top_word", "same_neighbour", "same_lines", "line_length", "line_ends", "marked_words", "upper_words", "stops", "long_words", "bars")
_ENDS = tuple(".!?:;\"'…")


def _code_classes() -> np.ndarray:
    """For each ASCII code: 0 letter, 1 digit, 2 blank, 3 symbol, 4 capital letter."""
    out = np.full(128, 3, np.int8)
    for c in range(128):
        s = chr(c)
        out[c] = 4 if s.isupper() else 0 if s.isalpha() else 1 if s.isdigit() else 2 if s.isspace() else 3
    return out


_CLASSES = _code_classes()


def text_features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(TEXT_FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_CLASSES[codes[codes < 128]], minlength=5)
    chars, letters = len(codes), kinds[0] + kinds[4] + int((codes >= 128).sum())
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    bare = [w.strip(".,;:!?\"'()") for w in words]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, letters / chars, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / max(1, letters),
        len(seen) / n, seen.most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines),
        float(np.log1p(chars / len(lines))), sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines), sum(not w.isalpha() for w in bare) / n,
        sum(w.isupper() and len(w) > 1 for w in bare) / n, (text.count(".") + text.count("!") + text.count("?")) / n, sum(len(w) > 25 for w in words) / n, text.count("|") / n,
    ]


def _text_view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t or "") for t in each(batch.column("text"))]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(rows, pa.list_(pa.float64()))], [*rest, "text_view"])


def _meta_columns(categories: Sequence[str], sizes: Sequence[str]) -> dict[str, Column]:
    """c0, c1, ...: the categories as text; n0, n1, ...: logarithms of the sizes and their squares."""
    out = {f"c{i}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for i, c in enumerate(categories)}
    for i, c in enumerate(sizes):
        log = F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))))
        out |= {f"n{2 * i}": log, f"n{2 * i + 1}": log * log}
    return out


def _vectors(made: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``made`` with text_view and meta_view as vectors, the latter sparse."""
    words, numbers = [c for c in columns if c.startswith("c")], [c for c in columns if c.startswith("n")]
    if words:
        made = FeatureHasher(numFeatures=META_COLUMNS, inputCols=words, outputCol="words").transform(made)
    made = VectorAssembler(inputCols=[*(["words"] if words else []), *numbers], outputCol="meta_view").transform(made)
    return made.withColumn("text_view", array_to_vector("text_view"))


def _fit(rows: DataFrame, view: str, label: Column) -> LogisticRegressionModel:
    """Logistic regression over all rows with a label."""
    data = rows.select(view, label.cast("double").alias("label")).where("label IS NOT NULL")
    return LogisticRegression(featuresCol=view, maxIter=20, regParam=1e-3, standardization=True).fit(data)


def _scored(rows: DataFrame, model: LogisticRegressionModel, out: str) -> DataFrame:
    """``rows`` with the model's logit as the column ``out``."""
    own = model.setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("")
    return own.transform(rows).withColumn(out, vector_to_array("raw")[1]).drop("raw")


def _probability(logit: str) -> Column:
    return 1 / (1 + F.exp(-F.col(logit)))


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def quality_scores(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("lang", "source"), sizes: Sequence[str] = ("n_chars",), doc_id: str = "doc_id", text: str = "text", label: str = "quality", rounds: int = ROUNDS, sure: float = SURE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted, text_score and meta_score of every row of ``docs``."""
    own = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    meta = _meta_columns(categories, sizes)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *[c.alias(k) for k, c in meta.items()])
    kinds = ", ".join(f"{k} {'string' if k.startswith('c') else 'double'}" for k in meta)
    made = written(rows.mapInArrow(tidy(_text_view), f"doc_id long, {kinds}, text_view array<double>"), "features")
    both = _vectors(made.join(own, "doc_id", "left").withColumn("fold", fold(F.col("doc_id"))), list(meta)).select("doc_id", "label", "fold", "text_view", "meta_view")
    both = written(both, "views")
    drop_written(made)
    given = F.when(F.col("fold") < 2, F.col("label"))
    known = {(r["train"], r["label"]): r["count"] for r in both.where("fold <> 2 AND label IS NOT NULL").groupBy((F.col("fold") < 2).alias("train"), "label").count().collect()}
    held = (F.col("fold") == 2).alias("held_out")
    if len(known) < 4:
        ones, every = sum(n for (_, x), n in known.items() if x == 1), sum(known.values())
        share = F.lit(ones / every if every else 1.0)
        return keeps(both.select("doc_id", held, share.alias("score"), (share >= threshold).cast("int").alias("predicted"), share.alias("text_score"), share.alias("meta_score")), both)
    by_text, by_meta = _fit(both, "text_view", given), _fit(both, "meta_view", given)
    views = lambda: _scored(_scored(both, by_text, "by_text"), by_meta, "by_meta")
    for _ in range(rounds):
        free, rated = F.col("label").isNull(), views()
        said = lambda view: F.when(_probability(view) >= sure, 1).when(_probability(view) <= 1 - sure, 0)
        by_text, by_meta = _fit(rated, "text_view", F.when(free, said("by_meta")).otherwise(given)), _fit(rated, "meta_view", F.when(free, said("by_text")).otherwise(given))
    rated = views().withColumn("both", array_to_vector(F.array("by_text", "by_meta")))
    rated = _scored(rated, _fit(rated, "both", F.when(F.col("fold") == 3, F.col("label"))), "logit").withColumn("score", _probability("logit"))
    return keeps(rated.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), _probability("by_text").alias("text_score"), _probability("by_meta").alias("meta_score")), both)
