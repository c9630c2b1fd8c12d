"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

The labels are weak: they are of whole documents, some wrong, missing or misspelt, while a subject must fill a fifth of the text;
and the part of the corpus a document comes from (its ``source``) makes some subjects likelier. So the classifiers
read sentences: trained first with the labels of their documents, then again with labels the
model and the document agree on, where a subject that is not among the labels stays possible as far as its source holds it.
A document's subject shares are those of its sentences; the threshold of each
subject is calibrated on all labelled documents that were held out.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the hashed feature space.
BUCKETS = 1 << 17
#: Bounds of the labelled sample that is read for training: documents, and characters of all their texts together.
MAX_LABELLED, MAX_LABELLED_CHARS = 8_000, 40_000_000
#: Subjects at most; the table of subjects is a list made by people.
MAX_SUBJECTS = 1000
#: Words of a stretch of text without full stops.
STRETCH = 14
#: Parts of the sample for cross-fitting.
FOLDS = 4
#: A subject fills about a fifth of the text or more.
MIN_SHARE = 0.2

_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n\s*|[。]|</?p>|<br ?/?>")
_WORD = re.compile(r"[^\W\d_]+")


def words(sentence: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(sentence)]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; texts without full stops are read in stretches of ``STRETCH`` words."""
    out = []
    for s in _SENTENCE.split(text):
        if s and (tokens := words(s)):
            out += [tokens] if len(tokens) <= 2 * STRETCH else [tokens[i : i + STRETCH] for i in range(0, len(tokens), STRETCH)]
    return out


@lru_cache(maxsize=400_000)
def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS


def features(tokens: list[str]) -> list[int]:
    """Hashed words, word pairs, and the words' beginnings, which hold where letters are lost or doubled."""
    grams = [_bucket(t) for t in tokens]
    grams += [_bucket(f"{a} {b}") for a, b in zip(tokens, tokens[1:])]
    grams += [_bucket(f"{t[:5]}*") for t in tokens if len(t) > 5]
    return grams


class Model:
    """Weights ``[BUCKETS, subjects + 1]`` (the last class: none) as float32; its size is fixed by the feature space."""

    def __init__(self, subjects: list[str], weights, bias, thresholds):
        self.subjects, self.weights, self.bias, self.thresholds = subjects, weights, bias, thresholds
        self._seen: dict[tuple, int] = {}

    def sentence_class(self, tokens: list[str]) -> int:
        """Index of the sentence's subject; ``len(subjects)`` for none."""
        import numpy as np

        key = tuple(tokens)
        known = self._seen.get(key)
        if known is None:
            grams = features(tokens)
            score = self.weights[grams].sum(axis=0) / max(1.0, len(grams)) ** 0.5 + self.bias if grams else None
            known = len(self.subjects) if score is None else int(np.argmax(score))
            if len(key) <= 60:
                if len(self._seen) >= 100_000:
                    self._seen.clear()
                self._seen[key] = known
        return known

    def shares(self, text: str):
        """Each subject's share of the text's letters, over all its sentences."""
        import numpy as np

        total, mine = 0, np.zeros(len(self.subjects) + 1)
        for tokens in sentences(text):
            size = sum(map(len, tokens))
            total += size
            mine[self.sentence_class(tokens)] += size
        return mine[:-1] / total if total else mine[:-1]

    def subjects_of(self, text: str) -> list[str]:
        share = self.shares(text)
        return [s for s, x, t in zip(self.subjects, share, self.thresholds) if x >= t]


class _Rows:
    """Sparse rows of hashed features: all numbers in one array and where each row begins."""

    def __init__(self, rows: Sequence[Sequence[int]]):
        import numpy as np

        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.grams = np.fromiter((g for r in rows for g in r), np.int32, int(self.size.sum()))

    def take(self, which):
        """The features of some rows one after another, and where each of these rows begins there."""
        import numpy as np

        size = self.size[which]
        first = np.cumsum(size) - size
        return self.grams[np.repeat(self.start[which] - first, size) + np.arange(int(size.sum()))], first, size


def _fit(rows: _Rows, which, target, weight, epochs: int = 12, rate: float = 0.5, decay: float = 1e-5):
    """One-versus-rest logistic regression by adaptive gradient steps over the rows ``which``; targets are soft, ``[rows, classes]``.

    Every class is fitted by itself, so a fit over some of the columns of ``target`` equals those columns of the whole one.
    """
    import numpy as np

    n, classes = len(which), target.shape[1]
    w, b = np.zeros((BUCKETS, classes), np.float32), np.zeros(classes, np.float32)
    squares, squares_b = np.full((BUCKETS, classes), 1e-6, np.float32), np.full(classes, 1e-6, np.float32)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        shuffled = which[order.permutation(n)]
        for at in range(0, n, 256):
            batch = shuffled[at : at + 256]
            grams, first, size = rows.take(batch)
            scale = (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32)
            z = np.add.reduceat(w[grams], first, axis=0) * scale[:, None] + b
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]) * weight[batch][:, None]).astype(np.float32)
            by_gram = np.argsort(grams, kind="stable")
            ordered = grams[by_gram]
            begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            unique, of = ordered[begins], np.repeat(np.arange(len(batch)), size)[by_gram]
            step = np.add.reduceat((error * scale[:, None])[of], begins, axis=0)
            step = step / len(batch) * 16 + decay * w[unique]
            squares[unique] += step * step
            w[unique] -= rate * step / np.sqrt(squares[unique])
            step_b = error.mean(axis=0)
            squares_b += step_b * step_b
            b -= 0.1 * step_b / np.sqrt(squares_b)
    return w, b


def _probabilities(rows: _Rows, which, w, b):
    """Each class's own probability, row by row; in pieces, to bound the memory."""
    import numpy as np

    out = np.empty((len(which), w.shape[1]), np.float32)
    for i in range(0, len(which), 2000):
        grams, first, size = rows.take(which[i : i + 2000])
        z = np.add.reduceat(w[grams], first, axis=0)
        out[i : i + 2000] = 1 / (1 + np.exp(-np.clip(z / np.sqrt(size)[:, None] + b, -30, 30)))
    return out


#: Runs a function on each of some items; ``map`` here, tasks of the cluster through ``in_tasks``.
Each = Callable[[Callable, Sequence], Sequence]


def in_tasks(spark) -> Each:
    """Runs each item as a task of its own; results must be small (a fold's probabilities, some columns of weights)."""

    def each(work: Callable, items: Sequence) -> list:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for i in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(work(items[i]))], pa.binary())], names=["i", "out"])

        found = spark.range(0, len(items), 1, numPartitions=len(items)).mapInArrow(run, "i long, out binary").collect()
        return [pickle.loads(r["out"]) for r in sorted(found, key=lambda r: r["i"])]

    return each


#: Document, text, labels and, where it is known, source.
Labelled = tuple[int, str, list[str]] | tuple[int, str, list[str], str | None]


def by_source(allowed, sources: Sequence[str | None]):
    """For each document the part of its source's labelled documents that has each label, shrunk by ten documents without any; 0 without source."""
    import numpy as np

    names, of = np.unique([x or "" for x in sources], return_inverse=True)
    parts = np.stack([allowed[of == k].sum(axis=0) / ((of == k).sum() + 10) * (names[k] != "") for k in range(len(names))])
    return parts[of].astype(np.float32)


def train(labelled: Sequence[Labelled], subjects: list[str], rounds: int = 3, each: Each = map) -> Model:
    """A model from ``(id, text, subjects, source)`` of labelled documents.

    In the first round a sentence has its document's labels in equal parts. Then a model that has not seen
    its document tells what the sentence is about, mostly within the document's labels; sentences that
    documents of many subjects hold become ``none``. A subject that is not among a document's labels keeps a tenth of its weight, and up to a
    tenth more as far as documents of the same source have it.
    """
    import numpy as np

    classes = len(subjects) + 1
    at = {s: i for i, s in enumerate(subjects)}
    found, doc_of = [], []
    allowed = np.zeros((len(labelled), classes), np.float32)
    for d, (_, text, names, *_) in enumerate(labelled):
        allowed[d, sorted({at[n] for n in names if n in at})] = 1
        for tokens in sentences(text or ""):
            found.append(features(tokens))
            doc_of.append(d)
    doc_of = np.array(doc_of, np.int64)
    if not found:
        return Model(subjects, np.zeros((BUCKETS, classes), np.float32), np.eye(1, classes, classes - 1, dtype=np.float32)[0], [MIN_SHARE] * len(subjects))
    rows = _Rows(found)
    mask, likely = allowed[doc_of], by_source(allowed, [x[3] if len(x) > 3 else None for x in labelled])[doc_of]
    target = mask / np.maximum(mask.sum(axis=1, keepdims=True), 1)
    target[:, -1] = (mask.sum(axis=1) == 0).astype(np.float32)
    weight = np.ones(len(found), np.float32)
    folds, every = doc_of % FOLDS, np.arange(len(found))
    for _ in range(rounds):
        # The scores of a sentence come from a model that has not seen its document.
        def held_out(k: int, target=target):
            seen, own = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
            return _probabilities(rows, own, *_fit(rows, seen, target, weight, epochs=5)) if len(seen) and len(own) else target[own]

        p = np.empty(target.shape, np.float32)
        for k, scores in enumerate(each(held_out, range(FOLDS))):
            p[folds == k] = scores
        p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-9)
        # A passing sentence occurs under every subject, so no class stands out: the flatter, the more likely "none".
        none = np.maximum(p[:, -1], np.clip((0.6 - p[:, :-1].max(axis=1) - p[:, -1]) / 0.2, 0, 1))
        other = 0.1 + 0.1 * likely[:, :-1]  # labels are missing at times, so others stay possible
        subject = p[:, :-1] * (other + (1 - other) * mask[:, :-1])
        subject = subject / np.maximum(subject.sum(axis=1, keepdims=True), 1e-9)
        target = np.concatenate([subject * (1 - none)[:, None], none[:, None]], axis=1).astype(np.float32)
    columns = [c for c in np.array_split(np.arange(classes), FOLDS) if len(c)]
    parts = list(each(lambda c: _fit(rows, every, np.ascontiguousarray(target[:, c]), weight, epochs=8), columns))
    return Model(subjects, np.concatenate([w for w, _ in parts], axis=1), np.concatenate([b for _, b in parts]), [MIN_SHARE] * len(subjects))


#: Thresholds that are tried, and the number of labels whose worth the prior of a fifth has.
GRID, PRIOR = tuple(round(0.1 + 0.01 * i, 2) for i in range(21)), 30


def calibrated(model: Model, reached: dict[tuple[str, int, bool], int]) -> Model:
    """``model`` with the threshold on the share of each subject that gives the best F1, shrunk towards a fifth by ``PRIOR`` labels' worth.

    ``reached`` counts held-out documents by subject, number of ``GRID`` thresholds their share reaches, and whether they have the label.
    """
    import numpy as np

    thresholds = []
    for s in model.subjects:
        count = np.array([[reached.get((s, k, y), 0) for k in range(len(GRID) + 1)] for y in (False, True)])
        at_least = count[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # documents that reach each threshold
        positives = count[1].sum()
        if positives == 0:
            thresholds.append(MIN_SHARE)
            continue
        f1 = 2 * at_least[1] / np.maximum(1, positives + at_least.sum(axis=0))
        best = np.array(GRID)[f1 >= f1.max() - 1e-9].mean()
        thresholds.append(float((best * positives + MIN_SHARE * PRIOR) / (positives + PRIOR)))
    return Model(model.subjects, model.weights, model.bias, thresholds)


def calibrate(model: Model, held_out: Sequence[Labelled]) -> Model:
    """As ``calibrated``, with held-out documents at hand."""
    reached: dict[tuple[str, int, bool], int] = {}
    for _, text, names, *_ in held_out:
        for s, x in zip(model.subjects, model.shares(text or "")):
            key = (s, sum(x >= g for g in GRID), s in names)
            reached[key] = reached.get(key, 0) + 1
    return calibrated(model, reached)


def labelled_documents(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """``doc_id, text, source, names, held``: all documents with a readable label; a fifth of them, by hash, is ``held`` out."""
    known = {s.strip().lower(): s for s in subjects}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
    spelt = labels.select("doc_id", F.try_element_at(table, F.lower(F.trim("subject"))).alias("name")).where("name IS NOT NULL AND doc_id IS NOT NULL")
    per_doc = spelt.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("names"))  # at most as many as there are subjects
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    met = documents.select("doc_id", "text", source.alias("source")).where("text IS NOT NULL").join(per_doc, "doc_id")
    return met.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def training_sample(labelled: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_LABELLED_CHARS) -> list[Labelled]:
    """Labelled documents that are not held out, whole, the first by hash, within both bounds.

    A document that does not fit into what is left of ``max_chars`` is left out; the others are not affected by it.
    """
    first = labelled.where("NOT held").select("doc_id", F.length("text").alias("chars"), F.xxhash64("doc_id").alias("place"))
    left, ids = max_chars, []
    for r in first.where(F.col("chars") <= max_chars).orderBy("place", "doc_id").limit(max_labelled).collect():
        if r["chars"] <= left:
            left -= r["chars"]
            ids.append((r["doc_id"],))
    if not ids:
        return []
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(ids, "doc_id long"))
    return sorted(((r["doc_id"], r["text"], r["names"], r["source"]) for r in labelled.join(wanted, "doc_id", "left_semi").collect()), key=lambda x: x[0])


def held_out_counts(labelled: DataFrame, model: Model) -> dict[tuple[str, int, bool], int]:
    """All held-out documents counted by subject, number of thresholds reached and label; scored where they are, only counts come back."""
    shares = F.posexplode(subject_shares(F.col("text"), model, labelled.sparkSession)).alias("_i", "share")
    each = labelled.where("held").select("names", shares)
    name = F.get(F.array(*[F.lit(s) for s in model.subjects]), F.col("_i"))
    passed = F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: F.col("share") >= g))
    counts = each.groupBy(name.alias("subject"), passed.alias("k"), F.array_contains("names", name).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return {(r["subject"], r["k"], r["y"]): r["n"] for r in counts.collect()}


def fit_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The model for a corpus: trained on a sample of four fifths of the labelled documents, calibrated on all others."""
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    labelled = labelled_documents(documents, labels, names)
    sample = training_sample(labelled, max_labelled)
    model = train(sample, names, each=in_tasks(spark) if sample else map)
    return calibrated(model, held_out_counts(labelled, model)) if names else model


def subject_shares(text: Column, model: Model, spark) -> Column:
    """Each subject's share of a text as ``array<double>``, in the order of the model's subjects."""
    name = uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast((model.subjects, model.weights, model.bias, model.thresholds))

    @F.arrow_udf("array<double>")
    def shares(texts):
        import pyarrow as pa

        own = _received(name, shipped)
        return pa.array([own.shares((b or b"").decode("utf-8", "replace")) for b in texts.to_pylist()], pa.list_(pa.float64()))

    return shares(text.cast("binary"))


def subjects_of(text: Column, model: Model, spark) -> Column:
    """The subjects of a text as ``array<string>``, empty for null, empty and wordless texts."""
    name = uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast((model.subjects, model.weights, model.bias, model.thresholds))

    @F.arrow_udf("array<string>")
    def found(texts):
        import pyarrow as pa

        own = _received(name, shipped)
        return pa.array([own.subjects_of((b or b"").decode("utf-8", "replace")) for b in texts.to_pylist()], pa.list_(pa.string()))

    return found(text.cast("binary"))


_received_models: dict[str, Model] = {}


def _received(name: str, shipped) -> Model:
    """The broadcast model once per Python worker, so that it remembers sentences from batch to batch."""
    if name not in _received_models:
        _received_models.clear()
        _received_models[name] = Model(*shipped.value)
    return _received_models[name]


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, subject``: one row per subject that fills about a fifth of a document's text or more.

    A map over the documents; only the labelled sample is collected for training. Without labels no document has a subject.
    """
    model = fit_subjects(documents, labels, subjects, max_labelled)
    return documents.select("doc_id", F.explode(subjects_of(F.col("text"), model, documents.sparkSession)).alias("subject"))
