"""Languages of texts and of their stretches of cues: nearest clustered centroid over character n-grams.

Training, on the driver, from a bounded sample of labelled sentences: every sentence is taken as it stands and in the
forms in which damaged texts show it (accents lost, letters replaced, read in a wrong encoding). Word-bounded n-grams of
1 to 5 characters are weighted by term frequency times inverse document frequency and normalised; per language,
spherical k-means gives several centroids.

Classification, distributed: the dot products of a text with the centroids are additive over its words, so each worker keeps
one row per distinct word (its products with all centroids) and its n-grams. The norm of a cue follows from its
n-grams' counts, which one sort of a batch's (cue, n-gram) pairs gives. A cue takes the language of the nearest centroid
by cosine; a cue whose best cosine is below ``reject`` has no language, but a text of such cues only is classified as a whole.
Within a text, switching the language
between cues costs ``switch_cost``, so that a doubtful cue goes with its
neighbours while one plainly in another language breaks their run.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

NONE = "und"  # no language

# Other codes and English names of languages; a code that only the training sentences have needs none.
LANGUAGE_NAMES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "es": ["spa", "spanish"],
    "pt": ["por", "portuguese"],
    "it": ["ita", "italian"],
    "nl": ["nld", "dut", "dutch"],
    "sv": ["swe", "swedish"],
    "pl": ["pol", "polish"],
    "tr": ["tur", "turkish"],
    "ru": ["rus", "russian"],
    "uk": ["ukr", "ukrainian"],
}
# How addresses begin, and what they end on (generic domains and one reserved for examples).
ADDRESS = re.compile(r"www\W|@|https?:|[^\W\d_]+\.(?:com|org|net|info|tv|example)\b", re.I)
ADDRESS_HINTS = ("www", "@", "http", ".com", ".org", ".net", ".info", ".tv", ".example")
# A credit: a label of several words, a colon and a single name, without the end of a sentence.
CREDIT = re.compile(r"^\W*[^\W\d_]+(?:[ \t]*[&/+,][ \t]*|[ \t]+)[^\W\d_]+[^:.!?\n]*:[ \t]*[^\W\d_]+[^\w.!?,…]*$")

WORD = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\*[^*\n]*\*|♪[^♪\n]*♪")
SPEAKER = re.compile(r"^[-\s]*[^\W\d_]+:\s", re.M)
CHUNK = 4096
AS_IT_STANDS = "\0"
MOST_WORDS = 400_000
DOUBTFUL = 0.4
BLOCK_WORDS = 100_000
SHARPNESS = 25.0


def declared_language(label: Column | str, codes: list[str] | None = None) -> Column:
    """Two-letter code of a label as found in the wild; null if it names none of the languages of LANGUAGE_NAMES nor is one
    of ``codes``."""
    names = {c: c for c in codes or []} | {name: code for code, others in LANGUAGE_NAMES.items() for name in (code, *others)}
    bare = F.lower(F.regexp_replace(F.regexp_replace(label, r"^\s+|\s+\z", ""), r"[-_].*\z", ""))
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[bare]


_BYTES = {chr(b): b for b in range(0x80, 0x100)} | {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_MISREAD = re.compile("(?:[\u00c2-\u00f4][" + "".join(re.escape(c) for c, b in _BYTES.items() if b < 0xC0) + "\ufffd]+)+")


def repair(text: str) -> str:
    """Undo a reading of UTF-8 as a one-byte Western encoding, wherever it shows; lost bytes stay replacement marks."""
    for _ in range(3):  # some texts were misread more than once
        mended = _MISREAD.sub(lambda m: bytes(_BYTES.get(c, 0xFF) for c in m[0]).decode("utf-8", "replace"), text)
        if mended == text:
            break
        text = mended
    return text


def damaged_forms(text: str) -> list[str]:
    """The sentence and the forms it takes in damaged texts."""
    stripped = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    forms = [text, stripped, re.sub(r"[^\x00-\x7f]", "?", text), repair(text.encode("utf-8").decode("cp1252", "replace"))]
    for written, read in (("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("cp1250", "cp1251"), ("cp1254", "cp1251")):
        try:
            forms.append(text.encode(written).decode(read, "replace"))
        except UnicodeEncodeError:
            pass
    return list(dict.fromkeys(f.lower() for f in forms))


def ngrams(word: str) -> Iterator[list[str]]:
    """All n-grams of the word, in lists of those that start within CHUNK letters, so that long words need no more memory."""
    w = f" {word} "
    for a in range(0, len(w), CHUNK):
        part = w[a : a + CHUNK + 4]
        found = [part[i : i + n] for n in range(1, 6) for i in range(min(CHUNK, len(part) - n + 1)) if n > 1 or part[i] != " "]
        if found:
            yield found


@dataclass
class Rows:
    """Sparse rows: ids and values of row r are those from starts[r] to starts[r + 1]."""

    starts: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def times(self, c: np.ndarray) -> np.ndarray:
        """Products with the rows of a dense matrix; no row of this one is empty."""
        return np.stack([np.add.reduceat(self.values * v[self.ids], self.starts[:-1]) for v in c], axis=1)

    def sum_of(self, rows: np.ndarray, width: int) -> np.ndarray:
        at = np.repeat(rows, np.diff(self.starts))
        return np.bincount(self.ids[at], self.values[at], width)


def _spherical_kmeans(x: Rows, width: int, k: int, rounds: int = 12, least_share: float = 0.03) -> np.ndarray:
    """Centroids of unit rows, started farthest first; deterministic.

    A cluster of less than ``least_share`` of the rows is given up: it holds strays, such as wrongly labelled rows.
    """

    def dense(r: int) -> np.ndarray:
        mine = np.zeros(len(x), bool)
        mine[r] = True
        return x.sum_of(mine, width)

    chosen = [dense(int(x.times(x.sum_of(np.ones(len(x), bool), width)[None])[:, 0].argmax()))]
    best = x.times(chosen[0][None])[:, 0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(dense(int(np.argmin(best))))
        best = np.maximum(best, x.times(chosen[-1][None])[:, 0])
    c = np.stack(chosen)
    for n in range(rounds):
        own = np.argmax(x.times(c), axis=1)
        sizes = np.bincount(own, minlength=len(c))
        keep = [j for j in range(len(c)) if sizes[j] > 0 and (n < rounds // 2 or sizes[j] >= least_share * len(x) or sizes[j] == sizes.max())]
        c = np.stack([x.sum_of(own == j, width) for j in keep])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Table:
    """Rows of equal kind that grow by doubling."""

    def __init__(self, width: int | None, kind: type):
        self.data = np.zeros((1024, width) if width else 1024, kind)
        self.size = 0

    def add(self, rows: np.ndarray) -> None:
        need = self.size + len(rows)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = rows
        self.size = need


@dataclass
class Model:
    """Centroids over n-grams; ``languages[j]`` is the language of centroid column j."""

    codes: list[str]
    languages: np.ndarray
    grams: dict[str, int]
    idf: np.ndarray
    weights: np.ndarray  # n-gram -> idf * centroid values
    idf_unseen: float
    words: dict[str, int] = field(default_factory=dict)

    def _start(self) -> None:
        """Tables of words: products with the centroids and squared weight of unseen n-grams; n-grams of each, end to end."""
        self.words.clear()
        self.products = Table(self.weights.shape[1] + 1, np.float32)
        self.found = Table(None, np.uint32)
        self.ends = Table(None, np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def word_ids(self, words: list[str]) -> np.ndarray:
        """Rows of words in the tables, computing those of new words; the tables start anew beyond MOST_WORDS."""
        if not self.words or len(self.words) > MOST_WORDS:
            self._start()
        known = self.words
        for w in dict.fromkeys(words):
            if w in known:
                continue
            known[w] = len(known)
            row = np.zeros((1, self.weights.shape[1] + 1), np.float32)
            for found in ngrams(w):
                at = np.array([self.grams.get(g, -1) for g in found])
                seen = at[at >= 0]
                row[0, :-1] += self.weights[seen].sum(axis=0)
                row[0, -1] += (len(at) - len(seen)) * self.idf_unseen**2
                self.found.add(seen.astype(np.uint32))
            self.products.add(row)
            self.ends.add(np.array([self.found.size]))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _squared_norms(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Squared TF-IDF norm of segments of words over the n-grams of the vocabulary: the pairs (segment, n-gram) are
        sorted, so the count of each n-gram in its segment is the length of a run."""
        bits = max(1, int(len(self.idf) - 1).bit_length())
        ends = self.ends.data
        per_word = ends[ids + 1] - ends[ids]
        before = np.concatenate([[0], np.cumsum(per_word)])
        where = np.repeat(ends[ids] - before[:-1], per_word) + np.arange(before[-1])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        of_segment = np.diff(before[bounds])
        key = np.repeat((np.arange(len(lengths), dtype=np.uint64) << np.uint64(bits)).astype(np.uint32 if len(lengths) << bits < 1 << 32 else np.uint64), of_segment)
        key |= self.found.data[where].astype(key.dtype)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        n = np.diff(np.append(first, len(key)))
        gram = key[first]
        weight = self.idf[(gram & gram.dtype.type((1 << bits) - 1)).astype(np.int64)] * n
        return np.bincount((gram >> gram.dtype.type(bits)).astype(np.int64), weight * weight, len(lengths))

    def cosines(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per segment of words the cosine with each language's nearest centroid."""
        bounds = np.append(starts, len(ids))
        out = np.zeros((len(starts), len(self.codes)), np.float32)
        a = 0
        while a < len(starts):  # bounded working memory: by words, one segment at least
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK_WORDS, "right")) - 1)
            b = min(b, len(starts))
            mine = ids[bounds[a] : bounds[b]]
            sums = np.add.reduceat(self.products.data[mine], starts[a:b] - bounds[a])
            norm = np.sqrt(self._squared_norms(mine, np.diff(bounds[a : b + 1])) + sums[:, -1])
            by_centroid = sums[:, :-1] / np.maximum(norm, 1e-6)[:, None]
            out[a:b] = np.stack([by_centroid[:, self.languages == j].max(axis=1) for j in range(len(self.codes))], axis=1)
            a = b
        return out


def fit(samples: list[tuple[str, str]], centroids: int = 6, least_texts: int = 2) -> Model:
    """Centroids from (language code, sentence) pairs; their number is the caller's documented bound.

    The inverse document frequency of an n-gram is log((1 + texts) / (1 + texts that hold it)), the forms of a sentence
    being texts of their own. An n-gram that fewer than ``least_texts`` hold is outside the vocabulary: wherever one stands
    it counts for itself in a norm, with the weight of the rarest of the vocabulary.
    """
    texts = [(lang, f) for lang, s in samples for f in ([s[1:]] if s.startswith(AS_IT_STANDS) else damaged_forms(s))]
    codes = sorted({lang for lang, _ in texts})
    counts: list[dict[str, int]] = []
    df: dict[str, int] = {}
    for _, text in texts:
        tf: dict[str, int] = {}
        for w in WORD.findall(text):
            for found in ngrams(w):
                for g in found:
                    tf[g] = tf.get(g, 0) + 1
        counts.append(tf)
        for g in tf:
            df[g] = df.get(g, 0) + 1
    kept = sorted(g for g, n in df.items() if n >= least_texts)
    grams = {g: i for i, g in enumerate(kept)}
    idf = np.log((1 + len(texts)) / (1 + np.array([df[g] for g in kept], float)))
    weights, languages = [], []
    for j, code in enumerate(codes):
        ids, values, starts = [], [], [0]
        for (lang, _), tf in zip(texts, counts):
            if lang != code:
                continue
            at = np.array([grams[g] for g in tf if g in grams], np.int64)
            v = np.array([n for g, n in tf.items() if g in grams]) * idf[at] if len(at) else np.zeros(0)
            norm = np.linalg.norm(v)
            if norm > 0:
                ids.append(at), values.append(v / norm), starts.append(starts[-1] + len(at))
        if not ids:
            continue
        c = _spherical_kmeans(Rows(np.array(starts), np.concatenate(ids), np.concatenate(values)), len(kept), centroids)
        weights.append(c)
        languages += [j] * len(c)
    w = (np.concatenate(weights) * idf).T.astype(np.float32) if weights else np.zeros((len(kept), 0), np.float32)
    unseen = float(np.log((1 + len(texts)) / (1 + least_texts)))
    return Model(codes, np.array(languages, int), grams, idf.astype(np.float64), np.ascontiguousarray(w), unseen)


def cue_segments(text: str) -> list[str]:
    """What stands before the first line with an arrow, and after each such line up to the next."""
    parts = text.replace("\r\n", "\n").replace("\r", "\n").split("-->")
    if len(parts) == 1:
        return parts
    out = [parts[0][: parts[0].rfind("\n") + 1]]
    for part in parts[1:-1]:
        end_of_line = part.find("\n")
        if end_of_line >= 0:  # else a second arrow in the same line
            out.append(part[end_of_line + 1 : part.rfind("\n") + 1])
    end_of_line = parts[-1].find("\n")
    return [*out, parts[-1][end_of_line + 1 :] if end_of_line >= 0 else ""]


def spoken_words(segment: str) -> list[str]:
    """Words of a cue's lines as in ``all_words``, none if all have a single letter."""
    words = all_words(segment)
    return words if any(len(w) > 1 for w in words) else []


def all_words(segment: str) -> list[str]:
    """Words of a cue's lines without markup, sound descriptions, adverts and speakers' names, in lower case."""
    if not segment.isascii():
        segment = repair(segment)
    if "<" in segment or "{" in segment:
        segment = MARKUP.sub(" ", segment)
    lower = segment.lower()
    if any(hint in lower for hint in ADDRESS_HINTS):
        segment = "\n".join(line for line in segment.split("\n") if not ADDRESS.search(line))
    if "[" in segment or "(" in segment or "*" in segment or "♪" in segment:
        segment = SOUND.sub(" ", segment)
    if ":" in segment:
        segment = "\n".join(line for line in segment.split("\n") if sum(map(str.isdigit, line)) < 6 and not CREDIT.match(line))
        segment = SPEAKER.sub(" ", segment)
    return WORD.findall(segment.lower())


def smooth(scores: np.ndarray, sizes: np.ndarray, switch_cost: float, sharpness: float) -> np.ndarray:
    """Language of each cue: the path of best total score, each change of language costing ``switch_cost``."""
    best = scores.argmax(axis=1)
    votes = np.bincount(best, minlength=scores.shape[1])
    top = votes.argmax()
    # Languages worth a path: several cues, or one that is plainly not in the main language.
    plain = np.bincount(best[scores.max(axis=1) - scores[:, top] > 0.1], minlength=scores.shape[1])
    states = np.flatnonzero((votes >= 3) | (plain > 0) | (np.arange(len(votes)) == top))
    if len(states) < 2:
        return np.full(len(scores), top)
    gain = (scores[:, states] * (sharpness * np.minimum(1.0, (sizes + 1) / 5.0))[:, None]).tolist()
    total, back = gain[0], []
    for row in gain[1:]:
        top = max(total)
        arg = total.index(top)
        stay = [t >= top - switch_cost for t in total]
        back.append([i if s else arg for i, s in enumerate(stay)])
        total = [(t if s else top - switch_cost) + g for t, s, g in zip(total, stay, row)]
    at = total.index(max(total))
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return states[np.array(path[::-1])]


def runs_of(labels: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of maximal stretches of equal labels."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)]))


def classify_texts(model: Model, texts: list[str | None], *, reject: float = 0.1, switch_cost: float = 0.4, sharpness: float = 8.0, run_cues: int = 4) -> list[tuple[int, int, int, str, float, bool]]:
    """(text number, cue_no, cues, language, confidence, mixed): cue_no 0 is the whole text, others its stretches.

    Every text has a row. Stretches of one language, however short, are given for texts in which there are several;
    ``mixed`` marks those of at least ``run_cues`` cues if a text has such stretches in two or more languages.
    A text without any cue line is one stretch of its own. Cues of single letters only and cues whose best cosine is
    below ``reject`` have no vote. A text that has no other cues takes the language of all its words together, with a
    confidence of at most DOUBTFUL; one without words has the language NONE and confidence 0. Confidence is the share of
    the language among all by the mean cosines of the stretch's cues, weighted by their words and sharpened.
    """
    words: list[str] = []
    owner, number, starts, size, spoken = [], [], [], [], []
    for t, text in enumerate(texts):
        if not text:
            continue
        segments = cue_segments(text)
        for cue, segment in enumerate(segments):
            found = all_words(segment)
            if not cue:
                found = [w for w in found if w != "webvtt"]
                if len(segments) > 1 and len(found) < 3:
                    continue
            if found:
                owner.append(t), number.append(cue), starts.append(len(words)), size.append(len(found)), spoken.append(any(len(w) > 1 for w in found))
                words += found
    out: list[tuple[int, int, int, int, np.ndarray | None, bool]] = []
    met = set(owner)
    if words and model.codes:
        ids = model.word_ids(words)
        cos = model.cosines(ids, np.array(starts)).astype(float)
        owner, number, size, starts = np.array(owner), np.array(number), np.array(size), np.array(starts)
        keep = (cos.max(axis=1) >= reject) & np.array(spoken)
        weighted = cos * size[:, None]
        bounds = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))

        def mean(rows: np.ndarray) -> np.ndarray:
            return weighted[rows].sum(axis=0) / size[rows].sum()

        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            use = a + np.flatnonzero(keep[a:b])
            if not len(use):
                first, last = starts[a], starts[b] if b < len(starts) else len(ids)
                whole = model.cosines(ids[first:last], np.zeros(1, int))[0].astype(float)
                out.append((int(owner[a]), 0, b - a, int(whole.argmax()), whole, True))
                continue
            labels = smooth(cos[use], size[use], switch_cost, sharpness)
            votes = np.bincount(labels, minlength=cos.shape[1])
            top = int(votes.argmax())
            out.append((int(owner[a]), 0, len(use), top, mean(use[labels == top]), False))
            numbered = use[number[use] > 0]
            labels = labels[number[use] > 0]
            runs = runs_of(labels) if len(labels) else []
            if len(runs) > 1:
                long = {labels[s] for s, e in runs if e - s >= run_cues}
                for s, e in runs:
                    out.append((int(owner[a]), int(number[numbered[s]]), e - s, int(labels[s]), mean(numbered[s:e]), len(long) > 1 and e - s >= run_cues))
    else:
        met = set()
    rows = [(t, 0, 0, NONE, 0.0, False) for t in range(len(texts)) if t not in met]
    if out:
        cos = np.stack([x[4] for x in out])
        p = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
        sure = np.round(p[np.arange(len(out)), [x[3] for x in out]] / p.sum(axis=1), 6)
        for (t, cue, cues, lang, _, flag), c in zip(out, sure.tolist()):
            # For a whole text the flag says that it is doubtful.
            rows.append((t, cue, cues, model.codes[lang], c if cue or not flag else min(c, DOUBTFUL), bool(cue and flag)))
    return sorted(rows, key=lambda r: r[:2])


def train(samples: DataFrame, lang: str, text: str, docs: DataFrame | None = None, key: str = "", *, most_samples: int = 20_000, most_documents: int = 3000, longest_document: int = 8000, texts_per_language: int = 300, centroids: int = 6) -> Model:
    """Fit on labelled sentences, then again with cues of labelled documents that the first fit confirms.

    Bounds: at most ``most_samples`` sentences and ``most_documents`` documents of at most ``longest_document``
    characters, those with the smallest hash; of the latter at most ``texts_per_language`` stretches of three cues per
    language. Documents whose label the first model does not confirm teach nothing, so wrong labels do not spread.
    Training reads nothing else; classification covers every document in full.
    """
    bare = F.lower(F.trim(F.col(lang)))
    own = F.coalesce(declared_language(lang), F.when(bare.rlike("^[a-z]{2,3}$"), bare))  # a code of its own names a language too
    rows = samples.select(own.alias("l"), F.col(text).alias("t")).where("l IS NOT NULL AND length(t) > 0").orderBy(F.xxhash64("t"), "t", "l").limit(most_samples).collect()
    pairs = [(r["l"], r["t"]) for r in rows]
    first = fit(pairs, centroids)
    if docs is None or not pairs:
        return first
    named = docs.select(F.col(key).alias("k"), declared_language("lang", first.codes).alias("l"), F.col("text").alias("t")).where(F.col("l").isin(first.codes))
    # A threshold on the hash leaves each task only its share of the sample to send; rows are counted without reading them.
    share = min(1.0, 2.5 * most_documents / max(1, docs.count()))
    labelled = named.where(F.xxhash64("k") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).where(F.length("t").between(1, longest_document))
    rows = labelled.orderBy(F.xxhash64("k"), "k", "t").limit(most_documents).collect()
    return fit(pairs + confirmed_stretches(first, [(r["l"], r["t"]) for r in rows], texts_per_language), centroids, 3)


def confirmed_stretches(model: Model, labelled: list[tuple[str, str]], most: int, cues: int = 3) -> list[tuple[str, str]]:
    """(code, words of a few cues) of documents of one language whose label the model confirms; not damaged further."""
    taken = dict.fromkeys(model.codes, 0)
    found: dict[int, list] = {}
    for n, cue, _, code, sure, _ in classify_texts(model, [t for _, t in labelled]):
        found.setdefault(n, []).append((cue, code, sure))
    out = []
    for n, lines in sorted(found.items()):
        code = labelled[n][0]
        if len(lines) > 1 or lines[0][1] != code or lines[0][2] < 0.5:
            continue
        words = [spoken_words(s) for s in cue_segments(labelled[n][1])[1:]]
        words = [w for w in words if w]
        for at in range(0, min(len(words), 2 * cues), cues):
            if taken[code] < most:
                taken[code] += 1
                out.append((code, " ".join(w for ws in words[at : at + cues] for w in ws)))
    return [(code, AS_IT_STANDS + t) for code, t in out]


def languages(docs: DataFrame, key: str, text: str, model: Model, label: str | None = None, **options) -> DataFrame:
    """key, cue_no, n_cues, lang, confidence, mixed: per text one row with cue_no 0, and one per stretch of a text in
    several languages; see ``classify_texts``.

    Texts that are null, empty or without words have the language NONE and confidence 0; a null key is kept as it is; repeated
    rows are classified each by itself. With ``label`` that string column comes back as ``label``.
    Other columns are not read. Texts are read whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        for b in batches:
            step = max(1, int(len(b) * 4_000_000 / max(1, b.column(1).nbytes)))
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                found = classify_texts(shared.value, part.column(1).to_pylist(), **options)
                if found:
                    n, cue, cues, lang, conf, mixed = zip(*found)
                    n = pa.array(n)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(n), part.column(2).take(n), pa.array(cue, pa.int32()), pa.array(cues, pa.int32()), pa.array(lang), pa.array(conf), pa.array(mixed)], ["key", "label", "cue_no", "n_cues", "lang", "confidence", "mixed"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), text, (F.col(label) if label else F.lit(None)).cast("string").alias("label")).mapInArrow(run, f"key {kind}, label string, cue_no int, n_cues int, lang string, confidence double, mixed boolean")
    return (out if label else out.drop("label")).withColumnRenamed("key", key)
