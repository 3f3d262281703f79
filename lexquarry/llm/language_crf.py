"""Language of every word by a linear-chain conditional random field, for texts that switch between languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import GOLD, drop_codes, hash_strings, mix, split_words, strings, text_slices

BUCKETS = 1 << 16
CHUNK = 32
LEXICON = 300


def features(words: pa.Array, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hashed feature) of words in lower case: affixes to 3 letters, 2- and 3-grams with word ends, letters
    beyond ASCII, lexicon. All words are hashed together, as code points."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    code = np.frombuffer(("<" + "><".join(strings(words)) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(n)
    begin, owner = end - n, np.repeat(np.arange(len(n)), n)
    place, left = np.arange(len(code)) - begin[owner], end[owner] - np.arange(len(code))
    bucket = lambda h, kind: (mix(h + np.uint64(kind * int(GOLD) & (1 << 64) - 1)) % np.uint64(BUCKETS)).astype(np.int64)
    grams, h = [], np.zeros(len(code), np.uint64)
    out = []
    for k in (1, 2, 3):
        h = h.copy()
        h[: len(code) - k + 1] = h[: len(code) - k + 1] * np.uint64(0x100000001B3) + code[k - 1 :]
        grams.append(h)
        if k > 1:
            at = np.flatnonzero(left >= k)
            out.append((owner[at], bucket(h[at], k)))
        long = np.flatnonzero(n >= k + 2)
        out.append((long, bucket(h[begin[long] + 1], 10 + k)))
        out.append((long, bucket(h[end[long] - 1 - k], 20 + k)))
    at = np.flatnonzero((code > 0x7F) & (place > 0))
    out.append((owner[at], bucket(code[at], 30)))
    if lexicon:
        known = list(lexicon)
        keys, own = hash_strings(pa.array(known, pa.large_string())), hash_strings(words)
        order = np.argsort(keys)
        where = order[np.minimum(np.searchsorted(keys, own, sorter=order), len(keys) - 1)]
        at = np.flatnonzero(keys[where] == own)
        out += [(at, bucket(np.array([lexicon[w] for w in known], np.uint64)[where[at]], 40)), (at, bucket(own[at], 41))]
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # from x to
    start: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: pa.Array | list[str]) -> np.ndarray:
        word, feature = features(pa.array(words, pa.large_string()) if isinstance(words, list) else words, self.lexicon)
        return np.stack([np.bincount(word, weights=self.weights[feature, j], minlength=len(words)) for j in range(len(self.labels))], axis=1)


def _chunks(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each chunk of at most `size` words, and where each text's chunks begin."""
    n = np.diff(offsets)
    per = -(-n // size)
    first = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(first[-1]) - first[:-1][text]
    start = offsets[:-1][text] + k * size
    return start, np.minimum(size, offsets[1:][text] - start), first


def forward_backward(emit: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, start: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label of each word, and the log of each text's sum over all label sequences.

    emit: scores of all words in order, one row a word. Exact for any length: every chunk of words is first multiplied into one
    matrix, all chunks at once; these carry the messages from chunk to chunk; then all chunks run side by side.
    """
    labels = emit.shape[1]
    top = emit.max(axis=1, keepdims=True) if len(emit) else np.zeros((0, 1))
    e = np.exp(emit - top)
    t, s0 = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    begin, length, first = _chunks(offsets, size)
    chunks, texts = len(begin), len(offsets) - 1
    is_first = np.zeros(chunks, bool)
    nonempty = np.flatnonzero(np.diff(first) > 0)
    is_first[first[:-1][nonempty]] = True
    # products: row vector in, row vector out
    prod = np.broadcast_to(np.eye(labels), (chunks, labels, labels)).copy()
    log_scale = np.zeros(chunks)
    # one or two chunks need no product of the last; all are computed for simplicity only where a text has several
    several = np.repeat(np.diff(first) > 1, np.diff(first))
    idx = np.flatnonzero(several)
    for i in range(size):
        idx = idx[length[idx] > i]
        if not len(idx):
            break
        step = prod[idx] @ t
        if i == 0:
            f = is_first[idx]
            step[f] = np.broadcast_to(np.eye(labels), (int(f.sum()), labels, labels)) * s0
        step *= e[begin[idx] + i][:, None, :]
        scale = step.max(axis=(1, 2), keepdims=True)
        prod[idx] = step / scale
        log_scale[idx] += np.log(scale[:, 0, 0])
    # messages into chunks
    ahead = np.ones((chunks, labels))  # after the chunk before; ones where the text begins
    behind = np.ones((chunks, labels))  # of what follows the chunk
    count = np.diff(first)
    k = 1
    live = np.flatnonzero(count > 1)
    while len(live):
        c = first[:-1][live] + k
        v = (ahead[c - 1][:, None, :] @ prod[c - 1])[:, 0]
        ahead[c] = v / v.sum(axis=1, keepdims=True)
        k += 1
        live = live[count[live] > k]
    k = 1
    live = np.flatnonzero(count > 1)
    while len(live):
        c = first[1:][live] - 1 - k
        v = (prod[c + 1] @ behind[c + 1][:, :, None])[:, :, 0]
        behind[c] = v / v.sum(axis=1, keepdims=True)
        k += 1
        live = live[count[live] > k]
    # inside chunks
    alpha, log_norm = np.empty_like(e), np.zeros(len(e))
    idx, v = np.arange(chunks), ahead
    for i in range(size):
        live = length[idx] > i
        idx, v = idx[live], v[live]
        if not len(idx):
            break
        w = v @ t
        if i == 0:
            f = is_first[idx]
            w[f] = s0
        w = w * e[begin[idx] + i]
        total = w.sum(axis=1, keepdims=True)
        v = w / total
        alpha[begin[idx] + i] = v
        log_norm[begin[idx] + i] = np.log(total[:, 0])
    beta = np.empty_like(e)
    v = behind
    order = np.arange(chunks)
    for i in range(size - 1, -1, -1):
        live = order[length > i]
        if not len(live):
            continue
        cur = v[live]
        beta[begin[live] + i] = cur
        nxt = (cur * e[begin[live] + i]) @ t.T
        v = v.copy() if v is behind else v
        v[live] = nxt / nxt.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    words = np.diff(offsets)
    sums = np.concatenate([[0], np.cumsum(log_norm + (top[:, 0] if len(e) else 0))])
    log_z = sums[offsets[1:]] - sums[offsets[:-1]] + np.maximum(words - 1, 0) * transitions.max() + (words > 0) * start.max()
    return p, log_z


def train(texts: list[list[str]], tags: list[list[int]], labels: list[str], rounds: int = 40, rate: float = 0.2, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by full-batch Adam. texts: words in lower case; tags: the label of each word."""
    k = len(labels)
    lexicon: dict[str, int] = {}
    flat = [w for t in texts for w in t]
    y = np.array([x for t in tags for x in t], np.int64)
    uniq, code = np.unique(np.array(flat, dtype=object), return_inverse=True)
    counts = np.zeros((len(uniq), k))
    np.add.at(counts, (code, y), 1)
    shares = (counts / np.maximum(counts.sum(axis=0), 1)).T
    for label in range(k):
        for i in np.argsort(-shares[label], kind="stable")[:LEXICON]:
            if counts[i, label] >= 3 and counts[i, label] > 0.6 * counts[i].sum():
                lexicon[uniq[i]] = label
    owner, cols = features(pa.array(uniq.tolist(), pa.large_string()), lexicon)
    used, cols = np.unique(cols, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w, t, s = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    inside = np.ones(len(y), bool)
    inside[offsets[:-1]] = False
    right = np.flatnonzero(inside)
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (y[right - 1], y[right]), 1)
    gold_s = np.bincount(y[offsets[:-1]], minlength=k)
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, t, s)]
    for step in range(1, rounds + 1):
        unique_scores = np.stack([np.bincount(owner, weights=w[cols, j], minlength=len(uniq)) for j in range(k)], axis=1)
        emit = unique_scores[code]
        p, pair = _marginals(emit, offsets, t, s)
        g_unique = np.zeros((len(uniq), k))
        for j in range(k):
            g_unique[:, j] = np.bincount(code, weights=p[:, j] - (y == j), minlength=len(uniq))
        g_w = np.stack([np.bincount(cols, weights=g_unique[owner, j], minlength=len(used)) for j in range(k)], axis=1)
        grads = [g_w / len(y) + decay * w / len(y), (pair - gold_t) / len(y), (p[offsets[:-1]].sum(axis=0) - gold_s) / max(1, len(texts))]
        for a, g, m in zip((w, t, s), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            a -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((BUCKETS, k))
    full[used] = w
    return Crf(labels, full, t, s, lexicon)


def _marginals(emit, offsets, transitions, start) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals and the expected number of each pair of neighbouring labels."""
    k = emit.shape[1]
    p, _ = forward_backward(emit, offsets, transitions, start)
    # P(y_i = a, y_i+1 = b) is proportional to alpha_i(a) T(a, b) e_i+1(b) beta_i+1(b), and alpha_i is recovered from both
    # marginals by one forward pass; texts in training are short, so that this runs over their places
    t = np.exp(transitions - transitions.max())
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    n = np.diff(offsets)
    alpha = np.empty_like(e)
    live = np.flatnonzero(n > 0)
    v = np.exp(start - start.max())[None] * e[offsets[live]]
    alpha[offsets[live]] = v / v.sum(axis=1, keepdims=True)
    i = 1
    while True:
        live = live[n[live] > i]
        if not len(live):
            break
        at = offsets[live] + i
        v = (alpha[at - 1] @ t) * e[at]
        alpha[at] = v / v.sum(axis=1, keepdims=True)
        i += 1
    inner = np.ones(len(e), bool)
    inner[offsets[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    q = alpha[at - 1][:, :, None] * t[None]  # joint before what follows, given the next label its column's share
    q /= q.sum(axis=1, keepdims=True)
    return p, (q * p[at][:, None, :]).sum(axis=0)


def word_table(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes, distinct words and offsets of what the field labels: words' letters in lower case; words without letters are left out."""
    codes, words, offsets = split_words(texts)
    clean = pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\p{L}]+|[^\p{L}]+$", "")) if len(words) else words
    keep = pc.not_equal(clean, "").to_numpy(zero_copy_only=False)
    if len(codes):
        codes, offsets = drop_codes(codes, offsets, keep[codes])
    # one code for words that differ in case or marks only
    d = clean.dictionary_encode() if len(clean) else None
    if d is not None:
        codes = d.indices.to_numpy()[codes] if len(codes) else codes
        return codes, d.dictionary, offsets
    return codes, words, offsets


def fit(docs: DataFrame, per_label: int = 80, words: int = 150, seed: int = 11) -> Crf | None:
    """Trains on the texts of the `per_label` least hashes of doc_id of each value of lang, of texts of any length that have a
    letter, at most `words` words of each text, and on as many code-switched sequences made of pieces of them. These are the
    bounds of the sample. Without labelled texts: None."""
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang").withColumn("r", F.row_number().over(pick)).where(F.col("r") <= per_label)
    wanted = [r["doc_id"] for r in ids.select("doc_id").collect()]
    begin = F.array_join(F.slice(F.split(F.trim(F.translate("text", "\t\n\r\f\x0b", "     ")), " +", 2 * words + 1), 1, 2 * words), " ").alias("text")
    rows = sorted({(r["lang"], r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isin(wanted) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", begin).collect()}) if wanted else []
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    codes, uniq, offsets = word_table(pa.array([r[2] for r in rows], pa.large_string()))
    uniq = strings(uniq)
    texts = [[uniq[c] for c in codes[a : min(b, a + words)]] for a, b in zip(offsets, offsets[1:])]
    pairs = [(t, labels.index(r[0])) for t, r in zip(texts, rows) if t]
    if not pairs:
        return None
    rng = np.random.default_rng(seed)
    out_x, out_y = [t for t, _ in pairs], [[y] * len(t) for t, y in pairs]
    for _ in range(len(pairs)):  # code-switched: two to five pieces
        x, y = [], []
        for i in rng.integers(0, len(pairs), rng.integers(2, 6)):
            t, label = pairs[i]
            size = int(rng.integers(3, 25))
            at = int(rng.integers(0, max(1, len(t) - size)))
            x += t[at : at + size]
            y += [label] * len(t[at : at + size])
        out_x.append(x)
        out_y.append(y)
    return train(out_x, out_y, labels)


SCHEMA = "doc_id long, n_words int, lang_top string, share_top double, confidence double, n_switches int, shares array<double>"


def _label(batches, model: Crf):
    k = len(model.labels)
    for batch in batches:
        for part in text_slices(batch):
            codes, words, offsets = word_table(part.column("text"))
            emit = model.emissions(words)[codes] if len(codes) else np.zeros((0, k))
            p, _ = forward_backward(emit, offsets, model.transitions, model.start)
            n = np.diff(offsets)
            sums = np.zeros((len(emit) + 1, k))
            np.cumsum(p, axis=0, out=sums[1:])
            shares = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)[:, None]
            shares = np.clip(shares, 0.0, 1.0)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            sure = np.concatenate([[0.0], np.cumsum(p.max(axis=1) if len(p) else np.zeros(0))])
            change = np.zeros(len(p) + 1, np.int64)
            if len(p) > 1:
                differs = best[1:] != best[:-1]
                differs[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(p))] - 1] = False
                change[2:] = np.cumsum(differs)
            last = np.maximum(offsets[1:], offsets[:-1])
            switches = np.where(n > 1, change[last] - change[np.minimum(offsets[:-1] + 1, last)], 0)
            top = shares.argmax(axis=1) if len(n) else np.zeros(0, np.int64)
            has = n > 0
            none = pa.array(~has)
            null = lambda a: pc.if_else(none, pa.scalar(None, a.type), a)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n.astype(np.int32)),
                    null(pa.array(np.array(model.labels, dtype=object)[top], pa.string())),
                    null(pa.array(np.round(shares[np.arange(len(n)), top], 6))),
                    null(pa.array(np.round((sure[offsets[1:]] - sure[offsets[:-1]]) / np.maximum(n, 1), 6))),
                    pa.array(switches.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, k, dtype=np.int32)), pa.array(np.round(shares.ravel(), 6))),
                ],
                ["doc_id", "n_words", "lang_top", "share_top", "confidence", "n_switches", "shares"],
            )


def label(docs: DataFrame, model: Crf | None) -> DataFrame:
    """For every row of docs: words that have letters, main language, its share of the words' probability, mean probability of
    the words' best labels, number of switches between them, and all shares, in the order of the model's labels.

    Whole texts are labelled. A text without letters, empty or null, or any text if there is no model, has null for language,
    share and confidence and no switches; null doc_ids stay; repeated rows are labelled each; other columns aren't looked at.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        model = Crf(["?"], np.zeros((BUCKETS, 1)), np.zeros((1, 1)), np.zeros(1), {})
        return src.mapInArrow(lambda it: _label(it, model), SCHEMA).withColumns({c: F.lit(None).cast(t) for c, t in (("lang_top", "string"), ("share_top", "double"), ("confidence", "double"))})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the hashed features, whatever the data
    return src.mapInArrow(lambda it: _label(it, shared.value), SCHEMA)


#: a text is rejected if it has no words, if no language has this share, or if its words' labels are this unsure
LEAST_SHARE, LEAST_CONFIDENCE = 0.5, 0.6


def accepted(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are; only the texts go through Python."""
    model = fit(docs, **parameters)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keeps(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], ["doc_id", "text"])
        out = [np.zeros(0, bool)]
        for r in _label([batch], shared.value):
            ok = pc.and_(pc.greater_equal(r["share_top"], LEAST_SHARE), pc.greater_equal(r["confidence"], LEAST_CONFIDENCE))
            out.append(pc.fill_null(ok, False).to_numpy(zero_copy_only=False))
        return pa.array(np.concatenate(out))

    return docs.where(keeps(F.col("text").cast("string")))


def judge(docs: DataFrame, **parameters) -> DataFrame:
    """label() by a model trained on docs' own lang, and keep: false for texts that language identification rejects.

    Null, empty and letterless texts are rejected, as are those in none of the languages that lang names. Without any labelled text
    there is nothing to tell languages by, and all rows are kept.
    """
    model = fit(docs, **parameters)
    keep = F.coalesce((F.col("share_top") >= LEAST_SHARE) & (F.col("confidence") >= LEAST_CONFIDENCE), F.lit(False))
    return label(docs, model).withColumn("keep", keep if model else F.lit(True))
