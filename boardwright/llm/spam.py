"""Keyword-stuffed pages, link lists and tag lists (problem 10).

Texts become sequences of function words and word classes. A trigram model of these classes, trained on the sentences of
the corpus, gives every token a surprisal, and a cache of the page's own words says how far each content word was to be
expected from what the page said before. Prose lies in the middle of both: links, tags and rows of a listing are
abnormally improbable as sequences, repeated keywords abnormally predictable. A page of which most words lie in abnormal
stretches is flagged.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardwright.session import cut

# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to and in for on with at by from is are was were be been this that these those it its as or not but you your we our they their i my me he she his her has have had will would can could should do does did if when then so than who which what where how about into out up more most one all any each every after before while during against without per no only also just there us them its because even yet",
    "de": "der die das den dem des ein eine einen einem einer eines und oder in im an am auf mit von vom zu zum zur für ist sind war wir sie ihr ihre unser unsere als auch sowie nach bei aus bis über unter dass nicht sich es ich du man werden wird haben hat noch nur wenn wie ab eng wer was wo ob da so dann doch aber denn weil damit durch gegen ohne ihm ihn ihren ihrem ihrer ihnen unseren unserem unserer uns euch mein meine meinen dein sein seine seinen seinem seiner dieser diese dieses diesen diesem jeder jede jedes jeden alle allen alles kein keine keinen mehr sehr hier dort dazu dabei kann können muss müssen soll sollen will wollen darf dürfen würde waren wurde wurden sei bin bist hatte hatten mich mir dir dich selbst beim ins ans vor zwischen seit etwa je",
    "fr": "le la les un une des du de et ou en dans pour avec sur par au aux est sont nous vous votre vos notre nos leur leurs ce cette ces qui que à chez se sa son ses plus ne pas il elle on dès sous entre mais si aussi très bien tout tous toute toutes cela ça y lui leurs mes tes ses mon ton ma ta je tu me te été être avoir ai as avons avez ont fait font peut peuvent doit doivent comme quand où dont sans vers chaque quel quelle quels quelles jusque après avant pendant depuis encore ni non afin n d l s c j qu",
    "es": "el la los las un una unos unas y o con por para en del al es son su sus nuestro nuestra nuestros se lo que como más de no si pero entre sobre desde hasta sin te le les muy ya este esta estos estas ese esa esos esas eso esto ser estar fue era eran está están ha han he hay tiene tienen tener cada todo toda todos todas otro otra también cuando donde quien cual porque ni mi tu me nos os yo él ella ellos ellas usted ustedes hacia según durante tras aquí así solo sólo tan e u",
}
#: A link of more than 200 characters and a chain of more than 100 hyphens go on as a token of their own, so that a token has under 256 words.
_TOKEN = re.compile(r"(?:https?:)?//[^\s<>\"')\]]{1,200}|www\.[^\s<>\"')\]]{1,200}|[#@]?[^\W_]+(?:['’\-][^\W_]+){0,99}|\n+|[^\w\s]|_")
_WORD = re.compile(r"[^\W_]+")
#: Words of a sentence that is trained on, and the share of the corpus's tokens that a context must have to be trusted by half.
SENTENCE, TRUST = (5, 60), 1e-3
#: Content words in a row, without a function word between them, that are told apart.
RUN = 40
#: Tokens to each side over which surprisal is averaged.
REACH = 5
#: A stretch is abnormal from HIGH robust deviations above the median class surprisal of the corpus's sentences on, or where
#: its content words cost under LOW of the median bits of sentences under the page's cache.
HIGH, LOW = 5.5, 1 / 3
#: Share of a page's words in abnormal stretches from which it is flagged; stretches reach a little beyond the odd words.
FLAG = 0.52
#: The page's cache: how many words back it reaches, so that a passage repeated as a whole stays prose, the weight of the word
#: alone against its pair with the word before it, of a new word against both, and the bits that a new word costs.
MEMORY, CACHE_PAIR, CACHE_WORD, NEW_BITS = 50, 0.5, 4.0, 13

# Codes of the classes: function words, content words by shape and place in their run, and marks.
_FUNCTION = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
_SHAPES = ("a", "Aa", "AA")
_NAMES = [*_FUNCTION, *(f"{c}{k}" for c in _SHAPES for k in range(1, RUN + 1)), "9", "URL", "TAG", "\n", "other", "start", *string.punctuation, *"–—…•·“”„«»¿¡€£"]
_CODE = {n: i for i, n in reversed(list(enumerate(_NAMES)))}
V = len(_NAMES)
_F = len(_FUNCTION)
_LOWER, _TITLE, _UPPER = (_CODE[f"{c}1"] for c in _SHAPES)
_NEWLINE, _START = _CODE["\n"], _CODE["start"]
#: Two tokens back only the kind of class counts: function word, content word first, second or later in its run, number,
#: end of a sentence, line break, other mark, link or tag. So there are at most K * V * V trigrams, under four million.
_KIND = np.full(V, 7)
_KIND[:_F] = 0
_KIND[_F : _F + 3 * RUN] = 1 + np.minimum(np.arange(3 * RUN) % RUN, 2)
for _names, _k in (("9", 4), (".!?", 5), ("\n", 6)):
    _KIND[[_CODE[c] for c in _names]] = _k
_KIND[[_CODE["URL"], _CODE["TAG"]]] = 8
_KIND[_START] = 9
K = 10
_PROSE_BIT = 1 << 14


def _table(codes) -> np.ndarray:
    return np.isin(np.arange(V), list(codes))


_IS_STOP = _table(_CODE[c] for c in ".!?\n")
_IS_END = _table(_CODE[c] for c in ".!?")
_IS_FUNCTION = _table(range(_F))
_IS_WORD = _table([*range(_F + 3 * RUN), *(_CODE[c] for c in ("9", "URL", "TAG"))])


def _kind(token: str) -> tuple[int, int]:
    """(code without the place in the run, number of words) of a token."""
    first, low = token[0], token.lower()
    if first == "\n":
        return _NEWLINE, 0
    if (first == "/" and len(token) > 1) or low.startswith(("http:", "https:", "www.")):
        return _CODE["URL"], len(_WORD.findall(token))
    if first in "#@" and len(token) > 1:
        return _CODE["TAG"], len(_WORD.findall(token))
    if first.isalnum():
        n = len(_WORD.findall(token))
        if low in _CODE and _CODE[low] < _F:
            return _CODE[low], n
        if first.isdigit():
            return _CODE["9"], n
        return (_UPPER if len(token) > 1 and token.isupper() else _TITLE if first.isupper() else _LOWER), n
    return _CODE.get(token, _CODE["other"]), 0


def _lately(keys: np.ndarray, memory: int) -> np.ndarray:
    """How often each key (well mixed 64 bits, of which the place takes the lowest) stood among the `memory` entries before."""
    n = len(keys)
    low = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    k = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))
    place = (k & low).astype(np.int64)
    k &= ~low
    group = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
    at = group * (n + memory) + place
    out = np.empty(n, np.int64)
    out[place] = np.arange(n) - np.searchsorted(at, at - memory)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Classifier:
    """Class codes of whole batches; what it remembers of tokens is bounded."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.ids: dict[str, int] = {}
        self.code: list[int] = []
        self.words: list[int] = []
        self.capital: list[bool] = []
        self.word_id: list[int] = []

    def _add(self, token: str) -> int:
        k = self.ids[token] = len(self.code)
        code, n = _kind(token)
        low = token.lower()
        self.code.append(code)
        self.words.append(n)
        self.capital.append(token[0].isupper() or token[0].isdigit())
        self.word_id.append(k)
        if low != token:
            self.word_id[k] = self.ids[low] if low in self.ids else self._add(low)
        return k

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, words per token, whether it begins with a capital or a digit, sixteenths of bits of the page's cache, first
        token of each text and the end)."""
        if len(self.code) > 400_000:
            self.reset()
        get, add = self.ids.get, self._add
        at, counts = [], []
        for t in texts:
            found = _TOKEN.findall(t) if t else []
            counts.append(len(found))
            for w in found:
                k = get(w)
                at.append(k if k is not None else add(w))
        ids = np.array(at, np.int64)
        start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        if not len(ids):
            return np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), start
        code, size = np.array(self.code)[ids], np.array(self.words, np.int64)[ids]
        doc = np.repeat(np.arange(len(texts)), counts)
        w = np.nonzero(size > 0)[0]
        wid, wdoc = np.array(self.word_id)[ids[w]], doc[w]
        content = code[w] >= _F
        edge = np.concatenate([[True], wdoc[1:] != wdoc[:-1]])
        # what the page's words just before say of each word: its pair with the word before it, and the word alone
        one = _mix(_mix(wdoc.astype(np.uint64) + np.uint64(1)) + wid.astype(np.uint64))
        word_n = _lately(one, MEMORY)
        first = np.nonzero(edge)[0]
        seen = np.minimum(np.arange(len(w)) - np.repeat(first, np.diff(np.concatenate([first, [len(w)]]))), MEMORY)
        before = np.where(edge, np.uint64(0), np.concatenate([one[:1], one[:-1]]))
        pair_n = _lately(_mix(before + one * np.uint64(3)), MEMORY)
        ctx_n = np.where(edge, 0, np.concatenate([[0], word_n[:-1]]))
        p = (word_n + CACHE_WORD * 2.0**-NEW_BITS) / (seen + CACHE_WORD)
        p = (pair_n + CACHE_PAIR * p) / (ctx_n + CACHE_PAIR)
        bits = np.zeros(len(ids), np.uint8)
        bits[w] = np.where(content, np.clip(np.round(-16 * np.log2(np.minimum(p, 1.0))), 0, 254), 255)
        bits[size == 0] = 255
        # place of a content word in its run
        run_words = np.where(content, size[w], 0)
        acc = np.cumsum(run_words)
        base = np.maximum.accumulate(np.where(~content | edge, acc - run_words, 0))
        place = np.clip(acc - base, 1, RUN)
        shaped = np.isin(code[w], (_LOWER, _TITLE, _UPPER))
        code[w] = np.where(shaped, code[w] + place - 1, code[w])
        return code.astype(np.int16), size, np.array(self.capital)[ids], bits, start


def _sentences(code: np.ndarray, size: np.ndarray, capital: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which tokens stand in sentences: from a capital or a number to a full stop, of a usual length, a fifth of the words
    function words, and an eighth different ones.

    Neither repeats nor links nor tags matter here. `start` holds where each text begins, and the end.
    """
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    stop = _IS_STOP[code]
    opens = np.concatenate([[True], stop[:-1]])
    opens[start[:-1][start[:-1] < n]] = True
    seg = np.cumsum(opens) - 1
    first = np.nonzero(opens)[0]
    k = len(first)
    last = code[np.concatenate([first[1:], [n]]) - 1]
    words, fun = (np.bincount(seg, table[code], minlength=k) for table in (_IS_WORD, _IS_FUNCTION))
    kinds = np.bincount(np.unique(seg[_IS_FUNCTION[code]] * V + code[_IS_FUNCTION[code]]) // V, minlength=k)
    head = np.full(k, n)
    word = np.flatnonzero(size > 0)
    np.minimum.at(head, seg[word], word)
    opened = np.where(head < n, capital[np.minimum(head, n - 1)], False)
    good = opened & (words >= SENTENCE[0]) & (words <= SENTENCE[1]) & (fun >= 0.2 * words) & (kinds >= np.maximum(2, 0.125 * words)) & _IS_END[last]
    # a line break between sentences belongs to the sentence before it
    alone = (last == _NEWLINE) & (np.bincount(seg, minlength=k) == 1)
    before = np.maximum.accumulate(np.where(alone, 0, np.arange(k)))
    text = np.searchsorted(start, first, side="right")
    good = np.where(alone, good[before] & (text[before] == text), good)
    return good[seg]


def _grams(code: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The trigram that ends at each token; stretches begin at `start`."""
    c = code.astype(np.int64)
    one, two = np.full(len(c), _START), np.full(len(c), _START)
    one[1:], two[2:] = c[:-1], c[:-2]
    begin = start[start < len(c)]
    one[begin] = two[begin] = _START
    begin = begin[begin + 1 < len(c)] + 1
    two[begin] = _START
    return (_KIND[two] * V + one) * V + c


def _classify_batches(batches):
    classify = Classifier()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            code, size, capital, bits, start = classify(part.column(1).to_pylist())
            code = (code | np.where(_sentences(code, size, capital, start), _PROSE_BIT, 0)).astype(np.int16)
            cols = [_blobs(x, start) for x in (code, size.astype(np.uint8), bits)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "codes", "sizes", "cache"])


def _blobs(x: np.ndarray, start: np.ndarray) -> pa.Array:
    """One binary value a text of what lies one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer((start * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes(column: pa.Array, kind=np.uint8) -> np.ndarray:
    """The values of a column of blobs, one after the other."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and len(column) else np.zeros(0, kind)


def _stored(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, whether in a sentence, starts) of the texts of a batch, one after the other."""
    code = _bytes(batch.column("codes"), np.int16)
    length = pc.binary_length(batch.column("codes")).to_numpy(zero_copy_only=False) // 2
    return code & (_PROSE_BIT - 1), code >= _PROSE_BIT, np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


def _stretches(ok: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts) of the stretches of sentences of more than five tokens."""
    opens = ok & ~np.concatenate([[False], ok[:-1]])
    begin = start[:-1][start[:-1] < len(ok)]
    opens[begin] = ok[begin]
    at = np.nonzero(ok)[0]
    if not len(at):
        return at, np.zeros(1, np.int64)
    piece = np.cumsum(opens[at]) - 1
    length = np.bincount(piece)
    keep = (length > 5)[piece]
    return at[keep], np.concatenate([[0], np.cumsum(length[length > 5])]).astype(np.int64)


def _count_batches(batches):
    counts = np.zeros(K * V * V, np.int64)
    for batch in batches:
        code, ok, start = _stored(batch)
        at, start = _stretches(ok, start)
        np.add.at(counts, _grams(code[at], start), 1)
    gram = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(counts[gram])], names=["gram", "n"])


def surprisals(counts: np.ndarray) -> np.ndarray:
    """Bits of every trigram under the interpolated model of these counts: each context adds to the shorter one as far as it
    is frequent, so that what follows within a rare context, such as a list, doesn't pass for usual.
    """
    three = counts.reshape(K, V, V).astype(float)
    prior = max(1.0, TRUST * counts.sum())
    p = np.full(V, 1.0 / V)
    for c in (three.sum((0, 1)), three.sum(0), three):  # the class alone, after one class, after two
        p = (c + prior * p) / (c.sum(-1, keepdims=True) + prior)
    return -np.log2(p).astype(np.float32).ravel()


def _windows(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the tokens within REACH of each in the same stretch."""
    length = np.diff(start)
    k = np.arange(start[-1])
    return np.maximum(k - REACH, np.repeat(start[:-1], length)), np.minimum(k + REACH + 1, np.repeat(start[1:], length))


def _sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    acc = np.concatenate([[0], np.cumsum(x, dtype=np.int64 if x.dtype.kind in "ui" else float)])
    return acc[hi] - acc[lo]


def perplexities(bits: np.ndarray, code: np.ndarray, cache: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Around each token: mean bits of the classes, and of the content words under the page's cache (infinite under five of them)."""
    lo, hi = _windows(start)
    has = cache < 255
    n = _sums(has.astype(np.uint8), lo, hi)
    expected = np.where(n >= 5, _sums(np.where(has, cache, 0), lo, hi) / (16.0 * np.maximum(n, 1)), np.inf)
    return _sums(bits[_grams(code, start)], lo, hi) / np.maximum(hi - lo, 1), expected


def classified(documents: DataFrame) -> DataFrame:
    """(doc_id, codes, sizes, cache): the class sequence of every text, kept as a table, as three passes read it."""
    kind = dict(documents.dtypes)["doc_id"]
    return cut(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_classify_batches, f"doc_id {kind}, codes binary, sizes binary, cache binary"))


def train(sequences: DataFrame) -> np.ndarray:
    """Bits of all trigrams from counts over the sentences of all documents; of bounded size whatever the corpus."""
    got = sequences.select("codes").mapInArrow(_count_batches, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(K * V * V)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return surprisals(counts)


def _bins(blob):
    """Histograms of the sentences by hundredths of a bit: 0 of classes, 1 of the page's cache."""

    def run(batches):
        hist = np.zeros((2, 10_000), np.int64)
        for batch in batches:
            code, ok, start = _stored(batch)
            at, pieces = _stretches(ok, start)
            long = np.repeat(np.diff(pieces) > 2 * REACH, np.diff(pieces))
            for k, s in enumerate(perplexities(blob.value, code[at], _bytes(batch.column("cache"))[at], pieces)):
                s = s[long & np.isfinite(s)]
                hist[k] += np.bincount(np.minimum((s * 100).astype(int), 9_999), minlength=10_000)
        kind, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(hist[kind, b])], names=["kind", "bin", "n"])

    return run


def _quantile(hist: list[tuple[int, int]], q: float) -> float:
    total, seen = sum(n for _, n in hist), 0
    for b, n in hist:
        seen += n
        if seen >= q * total:
            return b / 100
    return 0.0


def bounds(sequences: DataFrame, model) -> tuple[float, float]:
    """(class surprisal above which, cache bits under which) a stretch is abnormal; of a corpus without sentences, none is."""
    rows = sequences.mapInArrow(_bins(model), "kind int, bin int, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()  # at most 20,000 bins
    hist = [sorted((r["bin"], r["n"]) for r in rows if r["kind"] == k) for k in (0, 1)]
    high = _quantile(hist[0], 0.5) + HIGH * max(0.05, (_quantile(hist[0], 0.84) - _quantile(hist[0], 0.16)) / 2) if hist[0] else math.inf
    return high, LOW * _quantile(hist[1], 0.5) if hist[1] else -1.0


def _scorer(blob, high: float, low: float):
    def run(batches):
        for batch in batches:
            code, _, start = _stored(batch)
            size = _bytes(batch.column("sizes"))
            s, e = perplexities(blob.value, code, _bytes(batch.column("cache")), start)
            length = np.diff(start)
            doc = np.repeat(np.arange(len(length)), length)
            total = lambda x: np.bincount(doc, x, minlength=len(length))  # noqa: E731, B023
            words = total(size)
            shares = [total(size * odd) / np.maximum(words, 1) for odd in ((s > high) | (e < low), s > high, e < low)]
            bits = total(s) / np.maximum(length, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, shares), pa.array(bits), pa.array(words.astype(np.int64))], names=["doc_id", "spam_share", "high_share", "low_share", "bits", "words"])

    return run


def score_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_share, high_share, low_share, bits, words): share of words in abnormal stretches, in such of abnormally
    high class perplexity and of abnormally low perplexity under the page's cache, and mean class bits a token.

    NULL and empty texts have 0 words and share 0; without any sentence in the corpus nothing is abnormal. Whole texts;
    repeated rows give repeated rows.
    """
    sequences = classified(documents)
    model = documents.sparkSession.sparkContext.broadcast(train(sequences))
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, spam_share double, high_share double, low_share double, bits double, words bigint"
    return sequences.mapInArrow(_scorer(model, *bounds(sequences, model)), schema)


def spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the pages that are mostly keywords, links or tags."""
    return score_pages(documents).where(F.col("spam_share") >= FLAG).select("doc_id").distinct()
