"""Subject areas of documents by bisecting k-means and leaf mixtures (problem 8).

Normalised TF-IDF vectors of all documents are clustered by bisecting k-means. Each leaf is labelled by
its discriminative terms: they are held against those of the labelled documents of each subject, and
against the labels of its own documents; so it gets a mixture of subjects. The mixtures give every term its
odds for the subjects, and every sentence of a document the mixture of the document's leaf to begin with; its
terms then decide between the subjects of the leaf. A few rounds over all documents renew both, the leaves'
mixtures and the terms' odds. A document's subjects are those of at least a quarter of its sentences.

Terms and term pairs are hashed into a fixed number of buckets, so that model and driver memory are
bounded whatever the corpus. Only the labelled documents may be sampled, by MOST_LABELLED.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

LEAVES, VECTOR_SIZE, KMEANS_ROUNDS = 128, 4096, 4
BUCKETS = 1 << 17
EM_ROUNDS = 4
QUARTER = 4
#: Bound of the labelled documents used to label leaves.
MOST_LABELLED = 100_000
#: More subjects than this are an error: the model has a column for each.
MOST_SUBJECTS = 200
#: Share of a leaf's mixture in what its sentences begin with; the rest is spread evenly, so that no subject is out of reach.
LEAF_SHARE = 0.25
#: Share of sentences about no subject before any is seen; weight of a labelled document against others at the start.
NONE_PRIOR, LABELLED_WEIGHT = 0.3, 30.0
#: Likelihood of a subject that only one sentence of a document speaks of, against one that many do.
ALONE = 0.1
#: Least information of a term about the class; occurrences by which rare terms are drawn to the average.
LEAST_GAIN, SHRINK = 0.3, 5.0

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_WORDS = re.compile(r"[^\W\d_]+")
_TEXT_START = re.compile(r"[^\W_]")


def sentences(text: str) -> list[str]:
    """Sentences: cut after . ! ? before white space and at line ends; pieces without letter or digit are none."""
    return [s for s in _SENTENCE.split(text) if _TEXT_START.search(s)]


def _features(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}

    def bucket(term: str) -> int:
        got = known.get(term)
        if got is None:
            if len(known) > 100_000:
                known.clear()
            got = known[term] = zlib.crc32(term.encode()) % BUCKETS
        return got

    for block in _chunks(blocks):
        out_f, out_n, out_w = [], [], []
        for text in block["text"]:
            flat, counts, words = [], [], []
            for s in sentences(unicodedata.normalize("NFKC", text).lower()):
                ws = _WORDS.findall(s)
                ids = {bucket(w) for w in ws}
                ids.update(bucket(a + " " + b) for a, b in zip(ws, ws[1:]))
                flat += ids
                counts.append(len(ids))
                words += [w for w in ws if len(w) > 1]
            words = list(dict.fromkeys(words))  # vectors are binary
            out_f.append(np.array(flat, np.int32))
            out_n.append(np.array(counts, np.int32))
            out_w.append(np.array(words, object))
        yield pd.DataFrame({"doc_id": block["doc_id"], "flat": out_f, "counts": out_n, "words": out_w})


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, flat, counts, words): hashed terms and term pairs of all sentences, end to end; how many each sentence has; all different words.

    Null and blank texts have no sentences and no row.
    """
    typed = dict(documents.dtypes)["doc_id"]
    out = documents.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(_features, f"doc_id {typed}, flat array<int>, counts array<int>, words array<string>")
    return out.where(F.size("counts") > 0)


def cluster(feats: DataFrame, leaves: int = LEAVES, seed: int = 7):
    """(documents with leaf and vector, leaf centres): bisecting k-means over the normalised TF-IDF vectors of all documents."""
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=VECTOR_SIZE, binary=True)
    counted = tf.transform(feats.where(F.size("words") > 0).select("doc_id", "words"))
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(counted)
    vectors = Normalizer(inputCol="tfidf", outputCol="features").transform(idf.transform(counted)).select("doc_id", "features")
    model = BisectingKMeans(k=leaves, maxIter=KMEANS_ROUNDS, seed=seed, predictionCol="leaf").fit(vectors)
    return model.transform(vectors), np.array(model.clusterCenters())


def labelled_documents(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subjects): the labels of a document together; of more than MOST_LABELLED documents those first by hash."""
    sets = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    return sets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)


def leaf_subjects(clustered: DataFrame, centres: np.ndarray, labelled: DataFrame, subjects: list[str]) -> np.ndarray:
    """Mixture of subjects of each leaf (leaves x subjects), rows summing to 1.

    Discriminative terms of a leaf are where its centre exceeds the mean of all centres; those of a
    subject likewise from its labelled documents. Their likeness is the leaf's mixture before its own
    labelled documents are counted, each shared over its labels.
    """
    at = {s: i for i, s in enumerate(subjects)}
    seen = clustered.join(labelled, "doc_id").repartition(24, "doc_id")

    def sums(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, counts, leaf = np.zeros((len(at), VECTOR_SIZE)), np.zeros(len(at)), np.zeros((len(centres), len(at)))
        for block in blocks:
            for where, value, names, l in zip(block["where"], block["value"], block["subjects"], block["leaf"]):
                for s in names:
                    total[at[s], where] += np.asarray(value) / len(names)
                    counts[at[s]] += 1 / len(names)
                    leaf[l, at[s]] += 1 / len(names)
        rows = [("total", i, v) for i, v in enumerate(total)] + [("counts", 0, counts)] + [("leaf", i, v) for i, v in enumerate(leaf)]
        yield pd.DataFrame(rows, columns=["what", "row", "v"])

    sparse = seen.select("subjects", "leaf", vector_to_array("features").alias("dense"))
    sparse = sparse.select("subjects", "leaf", F.filter(F.transform("dense", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0).alias("nz")).select("subjects", "leaf", F.col("nz.i").alias("where"), F.col("nz.x").alias("value"))
    total, counts, leaf = np.zeros((len(at), VECTOR_SIZE)), np.zeros(len(at)), np.zeros((len(centres), len(at)))
    # at most (2 x subjects + leaves) vectors of fixed size for each of 24 tasks
    for what, row, v in sparse.mapInPandas(sums, "what string, row int, v array<double>").toLocalIterator():
        if what == "total":
            total[row] += v
        elif what == "counts":
            counts += v
        else:
            leaf[row] += v
    mean = centres.mean(0)
    special = np.maximum(centres - mean, 0)
    profile = np.maximum(total / np.maximum(counts, 1)[:, None] - mean, 0)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    like = np.exp(12 * (unit(special) @ unit(profile).T))
    like /= like.sum(1, keepdims=True)
    mixture = leaf + 2 * like
    return mixture / mixture.sum(1, keepdims=True)


def _flat(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate([np.asarray(x, np.int64) for x in block["flat"]])
    counts = np.concatenate([np.asarray(x, np.int64) for x in block["counts"]])
    return flat, counts, np.fromiter(map(len, block["counts"]), np.int64, len(block))


def sentence_mixtures(block: pd.DataFrame, odds: np.ndarray, mixtures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each sentence's class, flat, counts, sentences per document) under ``odds`` (buckets x classes) and the mixture of the document's leaf."""
    flat, counts, per_doc = _flat(block)
    score = np.zeros((len(counts), odds.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    if len(flat):
        score[full] = np.add.reduceat(odds[flat], starts[full], axis=0)
    score -= score.max(1, keepdims=True)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    prior = leaf_priors(mixtures)[block["leaf"].fillna(-1).to_numpy(np.int64)][doc]
    like = np.exp(score) * prior
    post = like / like.sum(1, keepdims=True)
    first = np.r_[0, np.cumsum(per_doc)[:-1]]
    long = (per_doc > QUARTER)[doc]  # in shorter ones a single sentence is a quarter
    for _ in range(2):  # a subject that no other sentence of the document speaks of is less likely: a passing mention
        others = np.add.reduceat(post, first, axis=0)[doc] - post
        support = (others + ALONE) / (others + 1)
        support[:, -1] = 1
        support[~long] = 1
        post = like * support
        post /= post.sum(1, keepdims=True)
    return post, flat, counts, per_doc


def leaf_priors(mixtures: np.ndarray) -> np.ndarray:
    """What a sentence begins with, by the leaf of its document; the last row is for documents without a leaf."""
    n = mixtures.shape[1]
    some = np.r_[LEAF_SHARE * mixtures + (1 - LEAF_SHARE) / n, np.full((1, n), 1 / n)]
    return np.c_[(1 - NONE_PRIOR) * some, np.full(len(some), NONE_PRIOR)].astype(np.float32)


def _chunks(blocks: Iterator[pd.DataFrame], size: int = 500) -> Iterator[pd.DataFrame]:
    for block in blocks:
        for i in range(0, len(block), size):
            yield block.iloc[i : i + size]


def _class_counts(feats: DataFrame, classes: int, leaves: int, each) -> tuple[np.ndarray, np.ndarray]:
    """(term counts by class: buckets x classes, sentence counts by class: leaves x classes), summed over all documents.

    ``each`` gives (row numbers, class weights of each) for a chunk; leaves stand behind the buckets. A task
    sends at most a row for each bucket and leaf; so many at most reach the driver.
    """
    columns, size = [f"c{c}" for c in range(classes)], BUCKETS + leaves

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, classes))
        for chunk in _chunks(blocks):
            at, weights = each(chunk)
            for c in range(classes):
                total[:, c] += np.bincount(at, weights=weights[:, c], minlength=size)
        used = np.flatnonzero(total.any(1))
        for i in range(0, len(used), 10_000):
            part = used[i : i + 10_000]
            frame = pd.DataFrame(total[part], columns=columns)
            frame.insert(0, "bucket", part.astype(np.int32))
            yield frame

    rows = feats.mapInPandas(run, "bucket int, " + ", ".join(f"{c} double" for c in columns)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    counts = np.zeros((size, classes))
    counts[rows["bucket"].to_numpy()] = rows[columns].to_numpy()
    return counts[:BUCKETS], counts[BUCKETS:]


def log_odds(counts: np.ndarray) -> np.ndarray:
    """log P(class | term) against P(class) of the terms that discriminate; 0 for the others.

    A term discriminates if knowing it says at least LEAST_GAIN nats about the class (divergence of its
    shrunken class distribution from that of all terms). Words that sentences of all subjects share, and
    that only a language or a form of letter makes common, would else outvote the few that tell.
    """
    prior = (counts.sum(0) + 1) / (counts.sum() + counts.shape[1])
    total = counts.sum(1, keepdims=True)
    post = (counts + SHRINK * prior) / (total + SHRINK)
    odds = np.log(post / prior)
    odds[(post * odds).sum(1) < LEAST_GAIN] = 0
    return odds.astype(np.float32)


def _packed(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are not 0; at most BUCKETS, so at most 8 MB with ten subjects."""
    used = np.flatnonzero(odds.any(1)).astype(np.int32)
    return used, odds[used]


def _unpacked(packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    odds = np.zeros((BUCKETS, packed[1].shape[1]), np.float32)
    odds[packed[0]] = packed[1]
    return odds


def described(areas: DataFrame, subjects: list[str]) -> np.ndarray:
    """Term counts by subject of the subjects' own descriptions, where there are any."""
    counts = np.zeros((BUCKETS, len(subjects)))
    if "description" in areas.columns:
        rows = areas.where("description IS NOT NULL").select("subject", "description").limit(10 * MOST_SUBJECTS).toPandas()
        for subject, text in zip(rows["subject"], rows["description"]):
            if subject in subjects:
                frame = next(_features(iter([pd.DataFrame({"doc_id": [0], "text": [text]})])))
                np.add.at(counts[:, subjects.index(subject)], np.asarray(frame["flat"][0], np.int64), LABELLED_WEIGHT)
    return counts


def fit(start: DataFrame, mixtures: np.ndarray, descriptions: np.ndarray, subjects: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(odds, mixtures): term odds from the leaves' mixtures, then both renewed over all documents, EM_ROUNDS times.

    ``start`` is (doc_id, flat, counts, leaf, subjects): features with leaf and labels, both null where there are none.
    """
    spark, n, leaves = start.sparkSession, mixtures.shape[1], len(mixtures)
    at = {x: i for i, x in enumerate(subjects)}

    def begin(chunk: pd.DataFrame):
        flat, counts, _ = _flat(chunk)
        per_doc = np.array([len(x) for x in chunk["flat"]])
        leaf = chunk["leaf"].fillna(-1).to_numpy(np.int64)
        doc = np.where(leaf[:, None] >= 0, mixtures[np.maximum(leaf, 0)], 1 / n)
        for i, names in enumerate(chunk["subjects"]):
            if names is not None:
                doc[i] = 0
                doc[i, [at[x] for x in names]] = LABELLED_WEIGHT / len(names)
        return flat, np.repeat(doc, per_doc, axis=0)

    counts, _ = _class_counts(start, n, leaves, begin)
    odds = np.c_[log_odds(counts + descriptions), np.zeros(BUCKETS, np.float32)]  # until sentences are told apart, no term speaks for no subject
    for _ in range(EM_ROUNDS):
        shared = spark.sparkContext.broadcast((_packed(odds), mixtures))

        def step(chunk: pd.DataFrame, shared=shared, held: list = []):  # noqa: B006
            if not held:
                held.append(_unpacked(shared.value[0]))
            post, flat, c, per_doc = sentence_mixtures(chunk, held[0], shared.value[1])
            hard = np.eye(post.shape[1], dtype=np.float32)[post.argmax(1)]  # soft weights would spread what is about nothing over all subjects
            leaf = np.repeat(chunk["leaf"].fillna(-1).to_numpy(np.int64), per_doc)
            has = leaf >= 0
            return np.r_[flat, BUCKETS + leaf[has]], np.r_[np.repeat(hard, c, axis=0), hard[has]]

        counts, by_leaf = _class_counts(start, n + 1, leaves, step)
        shared.destroy()
        odds = log_odds(counts)
        mixtures = by_leaf[:, :n] + mixtures  # a leaf without sentences about any subject keeps what it had
        mixtures = mixtures / mixtures.sum(1, keepdims=True)
    return odds, mixtures


def assign(start: DataFrame, odds: np.ndarray, mixtures: np.ndarray, subjects: list[str]) -> DataFrame:
    """(doc_id, sentences, subject, about): how many of a document's sentences are about each subject; all above 0."""
    shared = start.sparkSession.sparkContext.broadcast((_packed(odds), mixtures))
    n = len(subjects)

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, dense = np.array(subjects, object), _unpacked(shared.value[0])
        for chunk in _chunks(blocks):
            post, _, _, per_doc = sentence_mixtures(chunk, dense, shared.value[1])
            best = post.argmax(1)
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            about = np.bincount(doc * (n + 1) + best, minlength=len(per_doc) * (n + 1)).reshape(-1, n + 1)
            d, s = np.nonzero(about[:, :n])
            yield pd.DataFrame({"doc_id": chunk["doc_id"].to_numpy()[d], "sentences": per_doc[d].astype(np.int32), "subject": names[s], "about": about[d, s].astype(np.int32)})

    typed = dict(start.dtypes)["doc_id"]
    return start.select("doc_id", "flat", "counts", "leaf").mapInPandas(run, f"doc_id {typed}, sentences int, subject string, about int")


def model(documents: DataFrame, areas: DataFrame, labels: DataFrame, scratch: Scratch):
    """(documents with features and leaf, odds, mixtures, subjects), or None without subjects, labels or texts."""
    subjects = [r.subject for r in areas.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(subjects) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    feats = scratch.cut(features(documents), "features")
    if not subjects or not feats.where(F.size("words") > 0).limit(1).count() or not labels.limit(1).count():
        return None
    clustered, centres = cluster(feats)
    clustered = scratch.cut(clustered, "leaves")
    labelled = scratch.cut(labelled_documents(labels, subjects), "labelled")
    mixtures = leaf_subjects(clustered, centres, labelled, subjects)
    start = feats.select("doc_id", "flat", "counts").join(clustered.select("doc_id", "leaf"), "doc_id", "left").join(labelled, "doc_id", "left")
    start = scratch.cut(start, "start")
    odds, mixtures = fit(start, mixtures, described(areas, subjects), subjects)
    return start, odds, mixtures, subjects


def subject_counts(documents: DataFrame, areas: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """:func:`assign` for ``documents`` (doc_id, text), ``areas`` (subject, description), ``labels`` (doc_id, subject).

    Without subjects, labels or texts there are no rows. Copies of a text get equal subjects. Documents
    without doc_id cannot be told apart; they belong to no leaf.
    """
    fitted = model(documents, areas, labels, scratch)
    if fitted is None:
        return scratch.spark.createDataFrame([], f"doc_id {dict(documents.dtypes)['doc_id']}, sentences int, subject string, about int")
    return assign(*fitted)
