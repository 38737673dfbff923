"""Language identification of whole texts, with spans of mixed-language text.

Method. A word's script (Unicode ranges) narrows the languages to those written in it. Each language scores the word by a mixture
of its word frequencies and a model of character triples; scores become log posteriors over the candidates. Viterbi over the
words, with a penalty for each switch of language, labels spans. A text's language is the one whose spans hold most letters.

Training takes labelled rows only: ``PER_LANG`` documents per language at most (chosen by a hash of the id), the ``LANGUAGES`` most
frequent languages, and of each its most frequent words, ``WORDS`` over all languages together.

Scale. Prediction is one pass over the texts without a shuffle; the model is broadcast and bounded by the parameters above. Long texts
are cut into blocks whose paths are found for every state before the block and joined afterwards, so all blocks of a batch run
at once and the result is that of one path over the whole text.

Edge cases. Null text or text without a letter: ``und``, score 0. Words in a script of no learned language count for none. No
labelled row at all: every text is ``und``. Ties go to the language that sorts first. Repeated rows keep their rows; extra columns
are ignored; a null id takes part in training. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import texts

LANGUAGES, PER_LANG, WORDS = 256, 2000, 120_000
SWITCH, FLOOR, BLOCK, CACHED_WORDS = 8.0, -8.0, 256, 300_000
UNKNOWN = "und"
#: First code points of ranges and the script of each, from the Unicode block list. "other" holds the letters of the smaller blocks and of
#: signs; like any script, languages may be written in it.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "NKo"), (0x0800, "Samaritan"), (0x0840, "Mandaic"),
    (0x0860, "Syriac"), (0x0870, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Ogham"), (0x16A0, "Runic"), (0x1700, "Tagalog"),
    (0x1720, "Hanunoo"), (0x1740, "Buhid"), (0x1760, "Tagbanwa"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Canadian"),
    (0x1900, "Limbu"), (0x1950, "Tai Le"), (0x1980, "New Tai Lue"), (0x19E0, "Khmer"), (0x1A00, "Buginese"), (0x1A20, "Tai Tham"),
    (0x1AB0, "other"), (0x1B00, "Balinese"), (0x1B80, "Sundanese"), (0x1BC0, "Batak"), (0x1C00, "Lepcha"), (0x1C50, "Ol Chiki"),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Sundanese"), (0x1CD0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x2C00, "Glagolitic"), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"),
    (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, "other"), (0x3000, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, "other"), (0x31A0, "Bopomofo"), (0x31C0, "other"), (0x31F0, "Kana"), (0x3200, "other"),
    (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, "Lisu"), (0xA500, "Vai"), (0xA640, "Cyrillic"), (0xA6A0, "Bamum"), (0xA700, "other"),
    (0xA720, "Latin"), (0xA800, "Syloti Nagri"), (0xA830, "other"), (0xA840, "Phags-pa"), (0xA880, "Saurashtra"),
    (0xA8E0, "Devanagari"), (0xA900, "Kayah Li"), (0xA930, "Rejang"), (0xA960, "Hangul"), (0xA980, "Javanese"), (0xA9E0, "Myanmar"),
    (0xAA00, "Cham"), (0xAA60, "Myanmar"), (0xAA80, "Tai Viet"), (0xAAE0, "Meetei"), (0xAB00, "Ethiopic"), (0xAB30, "Latin"),
    (0xAB70, "Cherokee"), (0xABC0, "Meetei"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x10400, "Deseret"), (0x10450, "other"), (0x104B0, "Osage"),
    (0x10500, "other"), (0x10D00, "Rohingya"), (0x10D40, "other"), (0x11100, "Chakma"), (0x11150, "other"), (0x11400, "Newa"),
    (0x11480, "Tirhuta"), (0x114E0, "other"), (0x1AFF0, "Kana"), (0x1B170, "other"), (0x1E100, "Hmong"), (0x1E150, "other"),
    (0x1E2C0, "Wancho"), (0x1E300, "other"), (0x1E7E0, "Ethiopic"), (0x1E800, "Mende"), (0x1E8E0, "other"), (0x1E900, "Adlam"),
    (0x1E960, "other"), (0x20000, "Han"), (0x33480, "other"),
]
_BOUNDS = np.array([s[0] for s in SCRIPTS])
SCRIPT_NAMES = sorted({s[1] for s in SCRIPTS})
_SCRIPT = np.array([SCRIPT_NAMES.index(s[1]) for s in SCRIPTS])
LETTERS = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def scripts_of(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_BOUNDS, codes, side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_share: np.ndarray  # of each known word in each language
    triples: np.ndarray  # log counts by hash of three characters, with what is added to every count
    pairs: np.ndarray  # the same for two
    fits: np.ndarray  # script by language: whether the language is written in it

    def log_posteriors(self, runs: list[str]) -> np.ndarray:
        """Of each run of letters and language, over the languages that the script leaves; 0 everywhere if it leaves none."""
        codes, first = _codes(runs)
        three, two = _hashes(codes, len(self.triples))
        inner = np.ones(len(codes) - 2, bool)  # triples within a run and its marks: all but the two that straddle runs
        ends = first[1:-1]
        inner[ends - 2] = inner[ends - 1] = False
        gain = np.where(inner[:, None], self.triples[three] - self.pairs[two], 0)
        spelt = np.add.reduceat(gain, np.minimum(first[:-1], len(gain) - 1), axis=0)
        known = np.fromiter((self.words.get(r, -1) for r in runs), np.int64, len(runs))
        share = np.where((known >= 0)[:, None], self.word_share[np.maximum(known, 0)], 0)
        score = np.log(0.5 * np.exp(np.maximum(spelt.astype(np.float64), -600)) + 0.5 * share)
        fits = self.fits[scripts_of(codes[first[:-1] + 1])]
        score = np.where(fits, score, -1e9)
        top = score.max(axis=1, keepdims=True)
        out = score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))
        return np.where(fits.any(axis=1)[:, None], out, 0)


def _codes(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the runs, each between two marks, and where each begins (one entry more)."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(runs) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)) + 2)])


def _hashes(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    two = codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA77
    three = two[:-1] * 31 + codes[2:] * 0xC2B2AE3D
    return (three ^ (three >> 17)) % buckets, (two[:-1] ^ (two[:-1] >> 17)) % buckets


def train(labelled: DataFrame, lang_col: str = "lang") -> Model | None:
    """A model of (doc_id, text, lang); None without a labelled row."""
    counts = labelled.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(LANGUAGES).collect()
    if not counts:
        return None
    langs = sorted(r[lang_col] for r in counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[lang_col], min(1.0, PER_LANG / r["n"]))])
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.get(F.array(F.element_at(share, F.col(lang_col))), 0) * (1 << 20))
    each = max(200, WORDS // len(langs))
    word = picked.select(lang_col, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{1,64})"))).alias("word"))  # longer runs in pieces
    totals = word.groupBy(lang_col, "word").agg(F.count("*").alias("n"))
    top = totals.groupBy(lang_col).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))), 1, each).alias("words"), F.sum("n").alias("all"))
    buckets = 1 << (16 if len(langs) <= 32 else 13)
    words: dict[str, int] = {}
    shares: list[tuple[int, int, float]] = []
    triples, pairs = np.zeros((buckets, len(langs)), np.float32), np.zeros((buckets, len(langs)), np.float32)
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    for r in top.collect():
        lang, runs = langs.index(r[lang_col]), [w["word"] for w in r["words"]]
        if not runs:
            continue
        times = np.array([-w["less"] for w in r["words"]], np.float64)
        codes, first = _codes(runs)
        three, two = _hashes(codes, buckets)
        weight = np.repeat(times, np.diff(first))[:-2]
        inner = np.ones(len(three), bool)
        inner[first[1:-1] - 2] = inner[first[1:-1] - 1] = False
        triples[:, lang] = np.bincount(three[inner], weight[inner], buckets)
        pairs[:, lang] = np.bincount(two[inner], weight[inner], buckets)
        np.add.at(scripts[:, lang], scripts_of(codes[first[:-1] + 1]), times)
        shares += [(words.setdefault(w, len(words)), lang, n / r["all"]) for w, n in zip(runs, times.tolist(), strict=True)]
    table = np.zeros((max(1, len(words)), len(langs)), np.float32)
    for i, lang, part in shares:
        table[i, lang] = part
    fits = scripts > 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, words, table, np.log(triples + 0.05), np.log(pairs + 0.05 * 60), fits)


class WordScores:
    """Log posteriors and letters of raw words, made once for each; emptied when it holds more than ``CACHED_WORDS``."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at, self.scores, self.letters = {}, np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32)

    def look(self, words: list[list[str]]) -> list[np.ndarray]:
        """The row of each word of each text."""
        if len(self.at) > CACHED_WORDS:
            self.clear()
        new = list({w for ws in words for w in ws} - self.at.keys())
        if new:
            runs = [LETTERS.findall(w.lower()) for w in new]
            flat = [r for rs in runs for r in rs]
            scores = np.zeros((len(new), len(self.model.langs)))
            owner = np.repeat(np.arange(len(new)), [len(r) for r in runs])
            if flat:
                np.add.at(scores, owner, self.model.log_posteriors(flat))
            self.scores = np.concatenate([self.scores, np.maximum(scores, FLOOR).astype(np.float32)])
            letters = np.bincount(owner, [len(r) for r in flat], len(new)) if flat else np.zeros(len(new))
            self.letters = np.concatenate([self.letters, letters.astype(np.int32)])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        return [np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)) for ws in words]


def best_paths(scores: list[np.ndarray], switch: float = SWITCH, block: int = BLOCK) -> list[np.ndarray]:
    """The state of each word of each text, of the path of most score, where a change of state costs ``switch``.

    Blocks of all texts advance together. ``D[b, s, l]`` is the best score of block b that ends in l after state s stood before it.
    """
    states = scores[0].shape[1] if scores else 0
    spans = [(i, a, min(a + block, len(s))) for i, s in enumerate(scores) for a in range(0, len(s), block)]
    out = [np.zeros(len(s), np.int64) for s in scores]
    group = max(1, 2_000_000 // max(1, states * states * block))
    tables: list[tuple[np.ndarray, np.ndarray]] = [None] * len(spans)
    order = sorted(range(len(spans)), key=lambda b: spans[b][1] - spans[b][2])
    for g in range(0, len(order), group):
        chosen = order[g : g + group]
        sizes = np.array([spans[b][2] - spans[b][1] for b in chosen])
        padded = np.zeros((len(chosen), int(sizes[0]), states), np.float32)
        for k, b in enumerate(chosen):
            i, low, high = spans[b]
            padded[k, : high - low] = scores[i][low:high]
        best = np.full((len(chosen), states, states), -switch, np.float32)
        best[:, np.arange(states), np.arange(states)] = 0
        back = np.zeros((int(sizes[0]), len(chosen), states, states), np.uint8)
        own = np.arange(states)
        best += padded[:, :1]
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
        for t in range(1, int(sizes[0])):
            n = live[t]
            now = best[:n]
            top = now.argmax(axis=2)
            jump = np.take_along_axis(now, top[:, :, None], 2) - np.float32(switch)
            stay = now >= jump
            back[t, :n] = np.where(stay, own, top[:, :, None])
            best[:n] = np.maximum(now, jump) + padded[:n, t : t + 1]
        for k, b in enumerate(chosen):
            tables[b] = (best[k], back[: sizes[k], k])
    b = 0
    for i, s in enumerate(scores):
        mine = range(b, b + -(-len(s) // block))
        b += len(mine)
        value, before = np.zeros(states, np.float64), []
        for m in mine:
            total = value[:, None] + tables[m][0]
            before.append(total.argmax(axis=0))
            value = total.max(axis=0)
        state = int(value.argmax()) if len(mine) else 0
        for m, entry in zip(reversed(mine), reversed(before), strict=True):
            _, low, high = spans[m]
            start, back = int(entry[state]), tables[m][1]
            for t in range(high - low - 1, -1, -1):
                out[i][low + t] = state
                if t:
                    state = int(back[t, start, state])
            state = start
    return out


def spans_of(states: np.ndarray, places: np.ndarray, n: int, langs: list[str]) -> list[dict]:
    """Runs of one state as word ranges [start, end) that cover all ``n`` words; ``places`` are the words that have a state."""
    if not len(states):
        return []
    cuts = np.flatnonzero(np.diff(states)) + 1
    begins = [0, *places[cuts].tolist()]
    return [{"lang": langs[states[c]], "start": a, "end": z} for c, a, z in zip([0, *cuts.tolist()], begins, [*begins[1:], n], strict=True)]


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", *, switch: float = SWITCH, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans (of blank-separated words), and with ``keep`` the whole input row as ``row``."""
    docs, shared = texts(df, id_col, text_col), df.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>"
    if keep:
        docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
        schema += f", row struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.schema.fields)}>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = WordScores(model) if model else None
        for batch in batches:
            preds, scores, spans = [], [], []
            if model is None:
                preds, scores, spans = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            else:
                words = [(t or "").split() for t in batch.column("text").to_pylist()]
                rows = cache.look(words)
                places = [np.flatnonzero(cache.letters[r]) for r in rows]
                rows = [r[p] for r, p in zip(rows, places, strict=True)]
                paths = best_paths([cache.scores[r] for r in rows], switch)
                for row, place, path, ws in zip(rows, places, paths, words, strict=True):
                    if not len(row):
                        preds.append(UNKNOWN), scores.append(0.0), spans.append([])
                        continue
                    letters = cache.letters[row]
                    best = int(np.bincount(path, letters, len(model.langs)).argmax())
                    sure = np.exp(cache.scores[row, best].astype(np.float64)) * letters * (path == best)
                    known = (cache.scores[row] < 0).any(axis=1) if len(model.langs) > 1 else np.ones(len(row), bool)
                    preds.append(model.langs[best])
                    scores.append(float(min(1.0, (sure * known).sum() / letters.sum())))
                    spans.append(spans_of(path, place, len(ws), model.langs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, SPANS), *[batch.column("row") for _ in range(keep)]], names=["doc_id", "lang_pred", "score", "spans", *["row"] * keep])

    return docs.mapInArrow(run, schema)


def trained_on_folds(df: DataFrame) -> Model | None:
    """The model of the rows of (doc_id, text, lang) that are labelled and not held out."""
    return train(df.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
