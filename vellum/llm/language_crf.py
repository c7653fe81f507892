"""Missing or wrong document language labels: a linear-chain conditional random field over words.

Every word of a paragraph gets a distribution over languages by forward-backward; its emission score comes from hashed
affix and character n-gram features, the word itself (lexicon) and its script, the transitions are learned from texts
whose paragraphs change language. A paragraph's language is the one with the largest mass over its words, its confidence
that mass's share; the document's main language is the one most of its paragraphs are in. Inside a paragraph, runs of
words of one language are segments of their own (``mixed_segments``).

The languages are the codes that enough documents are labelled with. A label beyond them stands, unless the text is
plainly in one of them: the field cannot know such a language, but it knows how many words of its own a text holds.

The field is trained on a bounded, hash-chosen sample of labelled documents (``TRAIN_DOCUMENTS`` per language, whole
texts), in three passes: after the first, short one, paragraphs take the language the field gives them, so wrong labels
and mixed documents teach the transitions instead of blurring the words. Everything else reads all documents, whole, in
Arrow batches; words are scored once per batch and spelling, sequences by array operations.

Defined results: null or blank texts and null keys give no row; paragraphs without a letter (numbers, blanks) have no
language; ties of the main language go to the language with more words, then by code; repeated rows count once; without
any labelled document there is no language and no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Training documents per language, and labelled documents a language needs.
TRAIN_DOCUMENTS, LANGUAGE_DOCUMENTS = 220, 20
#: Words of one training sequence; longer texts are several.
SEQUENCE_WORDS = 400
BUCKETS = 1 << 15
EPOCHS, RATE, DECAY = 3, 0.08, 1e-6
#: A training paragraph leaves its document's label only where the field gives the label less than this share.
DOUBT = 0.25
#: A word is one of a language's own when it stands in this many of its training documents, and a text is in a language
#: its label denies the field's knowledge of from this share of such words on.
OWN_DOCUMENTS, OWN_SHARE = 3, 0.35
#: Words of a run inside a paragraph and the mean share of its language; shorter or weaker runs join the run before.
RUN_WORDS, RUN_SHARE = 3, 0.6
BATCH = 256

#: Notations of a language label (lower case), by two-letter code.
NOTATIONS = {
    "de": "de deu ger german deutsch germany", "en": "en eng english englisch anglais", "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais", "it": "it ita italian italiano", "pt": "pt por portuguese português portugues", "zh": "zh zho chi chinese 中文 汉语 漢語 cn mandarin",
}
#: Labels that say the language is unknown.
UNKNOWN_LABELS = ("", "und", "unknown", "unk", "n/a", "na", "none", "null", "-", "?", "xx", "zxx", "mul", "mis")

#: Label codes, two letters each, are languages; anything else is none.
_CODE = r"^[a-z]{2}$"
_TOKEN = re.compile(r"[⺀-鿿]|[^\W\d_]+(?:['’][^\W\d_]+)*")
FOUND = "doc_id bigint, label string, seg_no int, lang string, confidence double"
RUNS = "doc_id bigint, seg_no int, run_no int, first_word int, words int, lang string, confidence double"


def label_language(label: Column) -> Column:
    """The two-letter code a label stands for, '' when it says nothing, the label itself when it names another one."""
    base = F.regexp_extract(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"^([^-_\s(]*)", 1)
    whole = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    book = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for n in names.split() for x in (n, code)])
    return F.when(whole.isin(*UNKNOWN_LABELS) | base.isin(*UNKNOWN_LABELS), F.lit("")).otherwise(F.coalesce(F.try_element_at(book, base), whole))


def stated_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, label): the language every document says it is in, whatever the notation; '' where it says nothing."""
    return documents.where("doc_id IS NOT NULL").select("doc_id", label_language(F.col("lang")).alias("label")).distinct()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def feature_ids(word: str) -> list[int]:
    """Hashed features of a word: itself, affixes, character trigrams, script and case."""
    if "⺀" <= word[0] <= "鿿":
        return [zlib.crc32(b"S:han") % BUCKETS, zlib.crc32(("W:" + word).encode()) % BUCKETS]
    low = word.lower()
    padded = f"^{low}$"
    names = ["W:" + low, "S:lat" + ("C" if word[0].isupper() else "c")]
    names += [f"P{n}:{low[:n]}" for n in (1, 2, 3) if len(low) >= n]
    names += [f"E{n}:{low[-n:]}" for n in (1, 2, 3, 4) if len(low) >= n]
    names += ["T:" + padded[i : i + 3] for i in range(len(padded) - 2)]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def forward_backward(scores: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (B, T, L) and expected transitions (L, L) of a padded batch of emission scores."""
    b, t, n = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(move)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        step = (alpha[:, i - 1] @ a) * emit[:, i]
        step /= step.sum(axis=1, keepdims=True)
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = (emit[:, i + 1] * beta[:, i + 1]) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], step, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    gamma *= mask[:, :, None]
    return gamma, _expected_moves(alpha, beta, emit, mask, a)


def _expected_moves(alpha, beta, emit, mask, a):
    if alpha.shape[1] < 2:
        return np.zeros_like(a)
    ahead = emit[:, 1:] * beta[:, 1:]
    z = np.einsum("bti,ij,btj->bt", alpha[:, :-1], a, ahead)
    weight = mask[:, 1:] / np.maximum(z, 1e-300)
    return a * np.einsum("bti,btj->ij", alpha[:, :-1] * weight[:, :, None], ahead)


class Field:
    """The conditional random field: hashed emission weights and transitions."""

    def __init__(self, languages: tuple):
        self.languages = languages
        self.weights = np.zeros((BUCKETS, len(languages)), dtype=np.float32)
        self.move = np.zeros((len(languages),) * 2, dtype=np.float64)
        self.own: list[frozenset] = [frozenset() for _ in languages]
        self.memo: dict[str, np.ndarray] = {}

    def features(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids of all words one after the other, where each word's start)."""
        rows = []
        for w in words:
            ids = self.memo.get(w)
            if ids is None:
                if len(self.memo) > 300_000:  # names never end; start the memo anew, results are the same
                    self.memo.clear()
                ids = self.memo[w] = np.array(feature_ids(w), dtype=np.int64)
            rows.append(ids)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        return (np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)), np.cumsum(sizes) - sizes

    def scores(self, words) -> np.ndarray:
        """(words, languages) emission scores, with a last row of zeros for padding."""
        ids, start = self.features(words)
        out = np.zeros((len(start) + 1, len(self.languages)), dtype=np.float32)
        if len(start):
            out[:-1] = np.add.reduceat(self.weights[ids], start, axis=0)
        return out

    def marginals(self, sequences: list[list[str]]) -> list[np.ndarray | None]:
        """(T, L) marginals per sequence, batched by length."""
        out: list = [None] * len(sequences)
        codes, words = pd.factorize(np.array([w for s in sequences for w in s], dtype=object))
        table, at = self.scores(words), np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        start = 0
        while start < len(order):
            # Long texts: fewer at a time.
            t = len(sequences[order[min(start + BATCH, len(order)) - 1]])
            part = order[start : start + max(1, min(BATCH, 400_000 // t))]
            start += len(part)
            padded, mask = _padded([codes[at[i] : at[i + 1]] for i in part], len(words))
            gamma, _ = forward_backward(table[padded], mask, self.move)
            for r, i in enumerate(part):
                out[i] = gamma[r, : at[i + 1] - at[i]]
        return out

    def fit(self, data: list[tuple[list[str], np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> None:
        """Gradient ascent on the conditional likelihood of label sequences (AdaGrad)."""
        rng, n = np.random.default_rng(seed), len(self.languages)
        codes, words = pd.factorize(np.array([w for seq, _ in data for w in seq], dtype=object))
        at = np.concatenate([[0], np.cumsum([len(s) for s, _ in data])]).astype(np.int64)
        ids, start = self.features(words)
        sizes = np.diff(np.append(start, len(ids)))
        g2, m2 = np.full_like(self.weights, 1e-2), np.full_like(self.move, 1.0)
        for _ in range(epochs):
            order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 24)
            chunks = [order[k : k + 32] for k in range(0, len(order), 32)]
            for c in rng.permutation(len(chunks)):
                part = chunks[c]
                used, inner = np.unique(np.concatenate([codes[at[i] : at[i + 1]] for i in part]), return_inverse=True)
                picked = np.repeat(start[used], sizes[used]) + (np.arange(sizes[used].sum()) - np.repeat(np.cumsum(sizes[used]) - sizes[used], sizes[used]))
                rows = ids[picked]
                table = np.zeros((len(used) + 1, n), dtype=np.float32)
                table[:-1] = np.add.reduceat(self.weights[rows], np.cumsum(sizes[used]) - sizes[used], axis=0)
                cuts = np.cumsum([at[i + 1] - at[i] for i in part])[:-1]
                padded, mask = _padded(np.split(inner, cuts), len(used))
                gold, gold_mask = _padded([data[i][1] for i in part], 0)
                gamma, moves = forward_backward(table[padded], mask, self.move)
                diff = (np.eye(n)[gold] * gold_mask[:, :, None] - gamma)[mask]
                per_word = np.stack([np.bincount(padded[mask], weights=diff[:, k], minlength=len(used)) for k in range(n)], axis=1)
                where, back = np.unique(rows, return_inverse=True)
                spread = np.repeat(per_word, sizes[used], axis=0)
                grad = np.stack([np.bincount(back, weights=spread[:, k], minlength=len(where)) for k in range(n)], axis=1).astype(np.float32)
                grad -= DECAY * self.weights[where]
                g2[where] += grad**2
                self.weights[where] += RATE * grad / np.sqrt(g2[where])
                both = gold_mask[:, :-1] & gold_mask[:, 1:]
                seen = np.bincount((gold[:, :-1] * n + gold[:, 1:])[both], minlength=n * n).reshape(n, n)
                delta = seen - moves
                m2 += delta**2
                self.move += RATE * delta / np.sqrt(m2)


def _padded(rows: list[np.ndarray], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in a matrix filled up with ``filler``, where they are)."""
    sizes = np.array([len(r) for r in rows])
    mask = np.arange(sizes.max()) < sizes[:, None]
    out = np.full(mask.shape, filler, dtype=np.int64)
    out[mask] = np.concatenate(rows)
    return out, mask


def training_rows(documents: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample of labelled documents, by hash of the key."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", label_language(F.col("lang")).alias("lang"), "text").where(F.col("lang").rlike(_CODE))
    # At most 26 * 26 codes.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect() if r["n"] >= LANGUAGE_DOCUMENTS}
    if not counts:
        return []
    # A first thinning by hash keeps the ranking window small however common a language is.
    share = F.create_map(*[F.lit(x) for k, c in sorted(counts.items()) for x in (k, min(1.0, 2.0 * per_language / c))])
    spot = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) / 1_000_000
    thinned = rows.where(spot < F.try_element_at(share, F.col("lang"))).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id", "text"))
    chosen = thinned.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "r", "text").collect()  # at most per_language for every code
    return [(r["lang"], r["text"]) for r in sorted(chosen, key=lambda r: (r["lang"], r["r"]))]


def train(sample: list[tuple[str, str]]) -> Field:
    """A field from (language, text) rows: first by label, then by what the field says of every paragraph."""
    languages = tuple(sorted({k for k, _ in sample}))
    field, index = Field(languages), {k: i for i, k in enumerate(languages)}
    docs = [(index[k], [p for p in (tokens(x) for x in t.split("\n\n")) if p]) for k, t in sample]
    docs = [(k, ps) for k, ps in docs if ps]
    if not docs:
        return field
    # Short passes first: long training would memorise the wrong labels.
    field.fit(_sequences([(p, np.full(len(p), k)) for k, ps in docs for p in ps]), epochs=2)
    flat = [p for _, ps in docs for p in ps]
    for epochs in (1, EPOCHS):
        share = [m.mean(axis=0) for m in field.marginals(flat)]
        said, at, heard = [], 0, np.zeros((len(languages),) * 2)
        for k, ps in docs:
            own = [k if s[k] >= DOUBT else int(s.argmax()) for s in share[at : at + len(ps)]]
            at += len(ps)
            said.append(own)
            for x in own:
                heard[k, x] += 1
        # Labels are mostly right: a label whose paragraphs mostly go elsewhere is believed instead of the field.
        trusted = heard.argmax(axis=1) == np.arange(len(languages))
        # Whole documents as sequences: their language changes teach the transitions.
        data = [
            ([w for p in ps for w in p], np.concatenate([np.full(len(p), x if trusted[k] else k) for p, x in zip(ps, own)]))
            for (k, ps), own in zip(docs, said)
        ]
        memo = field.memo
        field = Field(languages)
        field.memo = memo
        field.fit(_sequences(data), epochs=epochs)
    # The words that are a language's own.
    seen: list[Counter] = [Counter() for _ in languages]
    for seq, gold in data:
        for k, w in {(int(k), w.lower()) for w, k in zip(seq, gold)}:
            seen[k][w] += 1
    field.own = [frozenset(w for w, c in s.items() if c >= OWN_DOCUMENTS) for s in seen]
    return field


def _sequences(data: list[tuple[list[str], np.ndarray]]) -> list[tuple[list[str], np.ndarray]]:
    """The same words in sequences of bounded length."""
    return [(s[i : i + SEQUENCE_WORDS], y[i : i + SEQUENCE_WORDS]) for s, y in data for i in range(0, len(s), SEQUENCE_WORDS)]


def trained_field(documents: DataFrame):
    """The field of a collection, as a broadcast of (languages, weights, transitions, own words)."""
    field = train(training_rows(documents))
    return documents.sparkSession.sparkContext.broadcast((field.languages, field.weights, field.move, field.own))


def _field(parts: tuple) -> Field:
    field = Field(parts[0])
    _, field.weights, field.move, field.own = parts
    return field


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", label_language(F.col("lang")).alias("label"), "text")


def labelled_segments(documents: DataFrame) -> DataFrame:
    """Columns of ``FOUND``: seg_no -1 is the document with its main language, the rest are its paragraphs."""
    shared = trained_field(documents)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = _field(shared.value)
        names = field.languages
        for b in batches:
            paragraphs = [t.split("\n\n") for t in b["text"]]
            flat = [tokens(p) for ps in paragraphs for p in ps]
            mass = [m.sum(axis=0) if m is not None else None for m in (field.marginals(flat) if names else [None] * len(flat))]
            out, at = [], 0
            for doc, said, ps in zip(b["doc_id"], b["label"], paragraphs):
                own, words = mass[at : at + len(ps)], flat[at : at + len(ps)]
                at += len(ps)
                votes, total = np.zeros(len(names)), np.zeros(len(names))
                for m in own:
                    if m is not None:
                        votes[int(m.argmax())] += 1
                        total += m
                if not votes.any():
                    continue
                k = max(range(len(names)), key=lambda k: (votes[k], total[k]))
                foreign = said if len(said) == 2 and said not in names and _own_share(field, k, words) < OWN_SHARE else None
                for i, m in enumerate(own):
                    if m is not None:
                        x = int(m.argmax())
                        lang = foreign if foreign and _own_share(field, x, words[i : i + 1]) < OWN_SHARE else names[x]
                        out.append((doc, said, i, lang, float(m[x] / m.sum())))
                out.append((doc, said, -1, foreign or names[k], float(total[k] / total.sum())))
            yield pd.DataFrame(out, columns=["doc_id", "label", "seg_no", "lang", "confidence"])

    return _texts(documents).mapInPandas(label, FOUND)


def _own_share(field: Field, k: int, paragraphs: list[list[str]]) -> float:
    words = [w.lower() for p in paragraphs for w in p]
    return sum(w in field.own[k] for w in words) / max(1, len(words))


def found_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): labels that are missing or wrong, and paragraphs in another than the main language."""
    rows = labelled_segments(documents)
    main = F.max(F.when(F.col("seg_no") == -1, F.col("lang"))).over(Window.partitionBy("doc_id", "label"))
    # Paragraphs and main language leave the same task, so this window only moves label rows, never texts.
    return (
        rows.withColumn("main", main)
        .where(((F.col("seg_no") == -1) & (F.col("label") != F.col("lang"))) | ((F.col("seg_no") >= 0) & (F.col("lang") != F.col("main"))))
        .select("doc_id", "seg_no", "lang").distinct()
    )


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang, confidence) of every document (-1) and paragraph."""
    return labelled_segments(documents).select("doc_id", "seg_no", "lang", F.round("confidence", 4).alias("confidence")).dropDuplicates(["doc_id", "seg_no"])


def word_runs(gamma: np.ndarray, least: int = RUN_WORDS, share: float = RUN_SHARE) -> list[tuple[int, int, int]]:
    """(first word, words, language) of every run of one language; short and weak runs join the run before."""
    best, runs = gamma.argmax(axis=1), []
    edges = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        k = int(best[a])
        plain = b - a >= least and gamma[a:b, k].mean() >= share
        if runs and (not plain or runs[-1][2] == k):
            runs[-1] = (runs[-1][0], b - runs[-1][0], runs[-1][2], runs[-1][3])
        elif runs and not runs[-1][3]:
            # Nothing plain came before: what did belongs here.
            runs[-1] = (runs[-1][0], b - runs[-1][0], k, True)
        else:
            runs.append((a, b - a, k, plain))
    return [r[:3] for r in runs]


def mixed_segments(documents: DataFrame) -> DataFrame:
    """Columns of ``RUNS``: the word runs of every paragraph that mixes languages, with the mean share of their language."""
    shared = trained_field(documents)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = _field(shared.value)
        for b in batches:
            where = [(doc, i, tokens(p)) for doc, t in zip(b["doc_id"], b["text"]) for i, p in enumerate(t.split("\n\n"))]
            out = []
            for (doc, i, _), gamma in zip(where, field.marginals([w for *_, w in where]) if field.languages else []):
                runs = word_runs(gamma) if gamma is not None else []
                if len(runs) > 1:
                    out += [(doc, i, n, a, size, field.languages[k], round(float(gamma[a : a + size, k].mean()), 4)) for n, (a, size, k) in enumerate(runs)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])

    return _texts(documents).select("doc_id", "text").distinct().mapInPandas(split, RUNS)
