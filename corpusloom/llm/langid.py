"""Language identification: script ranges narrow the candidates, and a Viterbi path over the words' scores, with a
penalty for each switch, labels spans of mixed-language text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold_batches, tidy, unused

#: First and last code points of scripts; letters elsewhere are of the script "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)],
}
NAMES = [*SCRIPTS, "other"]
_EDGES = sorted((a, b, k) for k, rs in enumerate(SCRIPTS.values()) for a, b in rs)

#: Labelled documents of each language that the model learns from, about: a bounded sample by hash of the id. Languages
#: that it knows at most: those with the most labelled documents, so that dirty labels don't make it grow.
SAMPLE, LANGUAGES = 1500, 512
#: Character n-grams of words with their ends marked, up to so many characters, in so many buckets.
LONGEST, BUCKETS = 4, 1 << 16
#: A language takes part for a script if that share of its training words is in it.
SCRIPT_SHARE = 1e-3
#: One word's score is a log-probability among the candidates, not under this; switching costs this much.
FLOOR, SWITCH = -6.0, 8.0
#: Words that a worker keeps scores of.
KNOWN_WORDS = 100_000
#: Texts that are taken from a batch, and characters that are labelled, at once.
ROWS, CHUNK_CHARS = 500, 1_000_000

#: Words: letters with their combining marks, which scripts of India and Thailand have within words.
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x900, 0x903), (0x93A, 0x94F), (0x951, 0x957), (0x962, 0x963), (0x981, 0x983), (0x9BC, 0x9D7), (0xB82, 0xB82), (0xBBE, 0xBCD), (0xBD7, 0xBD7), (0xE31, 0xE31), (0xE34, 0xE3A), (0xE47, 0xE4E), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20F0), (0x3099, 0x309A)))
LETTERS = re.compile(rf"(?:[^\W\d_]+[{_MARKS}]*)+")


def script_of(word: str) -> int:
    """The script of most of the word's letters; of several, that of the first letter among them."""
    if word.isascii():
        return 0
    found: dict[int, int] = {}
    for c in word:
        if not "\u0300" <= c <= "\u036f":  # marks that go with any script
            o = ord(c)
            k = next((k for a, b, k in _EDGES if a <= o <= b), len(SCRIPTS))
            found[k] = found.get(k, 0) + 1
    return max(found, key=found.get) if found else len(SCRIPTS)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of the words' n-grams with their ends marked, and of the words as a whole."""
    marked = ["<" + w.lower() + ">" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), size)
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        whole = word[: len(h)] == word[n - 1 :]
        buckets.append(h[whole])
        owners.append(word[: len(h)][whole])
    start = np.cumsum(size) - size
    place = (np.arange(len(code)) - np.repeat(start, size)).astype(np.uint64)
    full = np.add.reduceat((code + np.uint64(7)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)), start)
    buckets.append((full ^ (full >> np.uint64(31))) * np.uint64(0x94D049BB133111EB))
    owners.append(np.arange(len(marked)))
    return ((np.concatenate(buckets) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


class Model:
    """Log-probabilities of n-grams by language, and the scripts of each language."""

    def __init__(self, langs: list[str], logs: np.ndarray, scripts: np.ndarray):
        self.langs, self.logs, self.scripts = langs, logs, scripts
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Model:
        """From counts (language, bucket, n); buckets from BUCKETS on are the words by script."""
        langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(langs)}
        counts = np.zeros((BUCKETS + len(NAMES), len(langs)))
        for lang, bucket, n in rows:
            counts[bucket, at[lang]] = n
        own, by_script = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
        share = by_script / np.maximum(by_script.sum(axis=0), 1)
        return cls(langs, np.log(own / own.sum(axis=0)).astype(np.float32), share >= SCRIPT_SHARE)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of each word by language, among those that its script allows, or all if it allows none."""
        if len(self.index) > KNOWN_WORDS:
            self.index, self.rows = {}, self.rows[:0]
        if fresh := [w for w in words if w not in self.index]:
            bucket, owner = grams(fresh)
            s = np.stack([np.bincount(owner, log[bucket], len(fresh)) for log in self.logs.T], axis=1)
            may = self.scripts[[script_of(w) for w in fresh]]
            known = may.any(axis=1, keepdims=True)
            s = np.where(known, np.where(may, s, -np.inf), 0.0)
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            self.index.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.rows = np.concatenate([self.rows, np.maximum(s, FLOOR)])
        return self.rows[[self.index[w] for w in words]]


def viterbi(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each word; documents follow each other in scores, with these numbers of words.

    All documents take a step at once; the longest come first, so that those still going are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    long = lengths[order]
    n_docs, n_langs = len(long), scores.shape[1]
    back = np.zeros(scores.shape, np.int8 if n_langs < 128 else np.int32)
    best = np.zeros((n_docs, n_langs))
    live = np.searchsorted(-long, -np.arange(long[0] if n_docs else 0), side="left")  # documents with more than t words
    own = np.arange(n_langs)
    for t, n in enumerate(live):
        at = starts[:n] + t
        if t:
            v = best[:n]
            top = v.argmax(axis=1)
            moved = v[np.arange(n), top][:, None] - SWITCH
            switch = moved > v
            back[at] = np.where(switch, top[:, None], own)
            best[:n] = np.where(switch, moved, v) + scores[at]
        else:
            best[:n] = scores[at]
    labels = np.zeros(len(scores), np.int64)
    now = best.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return labels


def label(model: Model, texts: list[str | None], spans: bool = False) -> list[tuple]:
    """(language, score[, spans]) of each text: the language of most letters, and its share of all letters.

    spans: (start, end, language) of maximal runs of words of one language, in characters.
    """
    find = (lambda x: list(LETTERS.finditer(x))) if spans else LETTERS.findall
    out: list[tuple] = [("und", 0.0, []) if spans else ("und", 0.0)] * len(texts)
    if not model.langs:
        return out
    at = 0
    by_size = sorted((i for i, x in enumerate(texts) if x), key=lambda i: -len(texts[i]))
    while at < len(by_size):
        take, found, chars, n = [], {}, 0, 0
        while at < len(by_size) and (not chars or chars + len(texts[by_size[at]]) <= CHUNK_CHARS):
            i = by_size[at]
            at += 1
            chars += len(texts[i])
            if ws := find(texts[i]):
                take.append(i)
                found[i] = ws
                n += len(ws)
        if not take:
            continue
        flat = [m.group() if spans else m for i in take for m in found[i]]
        ids: dict[str, int] = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.int64, n)
        table = model.scores(list(ids))
        lengths = np.array([len(found[i]) for i in take])
        labels = viterbi(table[codes], lengths)
        letters = np.fromiter(map(len, ids), np.int64, len(ids))[codes]
        doc = np.repeat(np.arange(len(take)), lengths)
        held = np.bincount(doc * len(model.langs) + labels, letters, len(take) * len(model.langs)).reshape(len(take), -1)
        top = held.argmax(axis=1)  # a tie goes to the first language by code point
        share = held[np.arange(len(take)), top] / held.sum(axis=1)
        first = 0
        for k, i in enumerate(take):
            row = (model.langs[top[k]], float(share[k]))
            if spans:
                own = labels[first : first + lengths[k]]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                row = (*row, [(found[i][a].start(), found[i][b - 1].end(), model.langs[own[a]]) for a, b in zip(cuts, cuts[1:])])
            out[i] = row
            first += lengths[k]
    return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From (doc_id, text, lang): n-gram counts over a sample of about so many documents of each language, by a
    hash of the id. Workers count and add up; the driver gets one row for each language, of at most BUCKETS counts."""
    hold_batches(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not per:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    draw = F.crc32(F.concat(F.lit("sample|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / float(2**32)
    chosen = known.filter(draw < F.try_element_at(share, F.col("lang"))).select("lang", "text")
    ddl = "lang string, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = seen.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                if ws := LETTERS.findall(text):
                    own[:BUCKETS] += np.bincount(grams(ws)[0], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount([script_of(w) for w in ws], minlength=len(NAMES))
        yield from _packed(seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one language follow each other, one at a time in memory."""
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, packed in zip(batch.column("lang").to_pylist(), batch.column("counts")):
                if lang not in seen:
                    yield from _packed(seen)
                    seen = {lang: np.zeros(BUCKETS + len(NAMES), np.int64)}
                at, n = np.frombuffer(packed.as_buffer(), np.int64).reshape(2, -1)
                seen[lang][at] += n
        yield from _packed(seen)

    rows = chosen.mapInArrow(count, ddl).repartition("lang").sortWithinPartitions("lang").mapInArrow(add, ddl).collect()
    return Model.of([(r["lang"], int(b), int(n)) for r in rows for b, n in np.frombuffer(r["counts"], np.int64).reshape(2, -1).T])


def _packed(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each language: the buckets that aren't 0, and their counts."""
    for lang, own in seen.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [np.stack([at, own[at]]).astype(np.int64).tobytes()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, model: Model, *, spans: bool = False, names: tuple[str, ...] = ("lang_pred", "score", "spans")) -> DataFrame:
    """docs with lang_pred and score, and spans if asked for, under these names; columns named so are replaced, others
    stay, whatever their names.

    lang_pred: the language that most of the text's letters are in, by the labelled spans; "und" with score 0 for
    null texts and those without letters, and where the model knows no language. A tie goes to the first language by
    code point. An empty table gives none; repeated rows are labelled alike. The model goes to the workers as a broadcast;
    it has BUCKETS numbers for each of at most LANGUAGES languages.
    """
    kind = "struct<lang_pred:string,score:double" + (",spans:array<struct<start:int,end:int,lang:string>>" if spans else "") + ">"
    hold_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    words = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    fields = [("lang_pred", pa.string()), ("score", pa.float64())] + [("spans", words)] * spans

    @F.arrow_udf(kind)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for part in texts:
            rows: list[tuple] = []
            for at in range(0, len(part), ROWS):
                rows += label(model, part.slice(at, ROWS).to_pylist(), spans)
            out = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            if spans:
                out.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows], words))
            yield pa.StructArray.from_arrays(out, [n for n, _ in fields])
        model.index, model.rows = {}, model.rows[:0]
        tidy()

    (found,) = unused(docs, "found")
    made = docs.withColumn(found, run("text"))
    return made.withColumns({n: F.col(found)[f] for n, (f, _) in zip(names, fields)}).drop(found)
