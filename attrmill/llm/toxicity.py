"""Toxicity by noisy-channel deobfuscation.

Restoring: a token that mixes letters with look-alike signs or repeats a letter
three times or more, and a run of single letters set apart by spaces or signs, is
read as the output of a noisy channel. Its lattice has, for each position, the
letters that may stand behind the sign (or one or two letters for a repeated
run), and at each separator an optional word break; Viterbi decoding under a
character trigram model picks the likeliest words; of spaced runs all readings within
`MARGIN` of the likeliest count. The reading without breaks counts as well, and so do the parts between separators that stand in words otherwise
unspaced, or that differ from the other separators of a spaced run. A token with two
or more doubled letters is also read with each of them single. The trigram model
counts the letters of all documents. Plain words are a lattice of one path and stay
as they are.

Scoring: an ordered list of rules over the restored text, learned by weighted
covering. A rule is a whole word or the beginning of a word (3 to 8 letters); its
weight is the lower end of the Wilson interval of the share of toxic training
documents among those that have it. The score of a text is the largest weight
among its words (0.01 if no rule fires).

The rules are a classifier fitted to at most `SAMPLE` labelled documents (the
first by a hash of the id; all where there are fewer), with at most `FEATURES`
candidate features and `RULES` rules; the three bounds are parameters. Scoring
reads every whole text and nothing but the text.

Rows: null and empty texts score 0.01. Without toxic training rows no rule
fires. Repeated rows score alike; rows without a label teach nothing; a document
with several labels counts as toxic if one says so.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrmill.llm.common import Memo, arrow_stage

SAMPLE, FEATURES, RULES = 20_000, 20_000, 300
LEAST_GAIN = 2.0
THRESHOLD = 0.7
LEAST_SCORE = 0.01
PREFIXES = range(3, 9)
#: Readings of a spaced run count down to this much (natural logarithm) under the likeliest one.
MARGIN = 10.0
#: A longer word inside a spaced run stands with its first letters only (rules on beginnings have at most 8).
LONGEST = 40

# ---- character model --------------------------------------------------------------------

#: 1..26 a-z, 27..58 the letters U+00DF..U+00FF (without the signs between), 0 anything else.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
_BASE = len(_LETTERS) + 1
_CODE = np.zeros(0x110000, np.uint8)
for _i, _c in enumerate(_LETTERS, 1):
    _CODE[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _CODE[ord(_c.upper())] = _i
_INDEX = {c: i for i, c in enumerate(_LETTERS, 1)}


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def _trigrams(batches):
    total = np.zeros(_BASE**3, np.int64)
    for b in batches:
        text = "  ".join(filter(None, b.column(0).to_pylist()))
        if len(text) < 3:
            continue
        c = codes(text).astype(np.int32)
        total += np.bincount((c[:-2] * _BASE + c[1:-1]) * _BASE + c[2:], minlength=_BASE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["g", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | two before it) from all texts; at most _BASE**3 counts reach the driver."""
    rows = arrow_stage(docs.select("text"), _trigrams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    total = np.full(_BASE**3, 0.01)
    total[rows["g"].to_numpy(np.int64)] += rows["n"].to_numpy(float)
    cube = total.reshape(_BASE, _BASE, _BASE)
    return np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)


# ---- channel ----------------------------------------------------------------------------

#: Signs and the letters that they may stand for. Fixed values.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou", "%": "x",
}
_SIGNS = re.escape("".join(LOOK_ALIKES))
_LETTER = r"[^\W\d_]"
#: Single letters (or signs) three or more, set apart by one space or sign each.
_SPACED = re.compile(rf"(?<!\w)(?:[^\W_]|[{_SIGNS}])(?:[ .\-_*,/]{{1,2}}(?:{_LETTER}|[{_SIGNS}])(?!\w)){{2,}}")
_UNIT = re.compile(rf"([ .\-_*,/]{{1,2}})({_LETTER}|[{_SIGNS}])(?!\w)")
_WORD = re.compile(rf"{_LETTER}+")
_PLAIN = re.compile(rf"[^\w$@€£|+*#!¡%]*{_LETTER}+[\W_]*")
_REPEAT = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"([^\W_]|[@$])\1")
_RUN = re.compile(r"(.)\1*")
#: What stands for no letter ends a part of a token.
_PART = re.compile(rf"(?:{_LETTER}|[{_SIGNS}])+")
_TRIM = " .,;:?\"'`)]}[{>~^=&\\/-_"


def decode(token: str, model: np.ndarray, breaks: bool = False, single: bool = False) -> str:
    """The likeliest word behind a token: Viterbi over states (last two letters, kept string).

    breaks: a separator may end a word; the words found are set apart by a blank.
    single: a doubled letter may stand for one."""
    slots: list[tuple[str, ...]] = []
    i, n, apart = 0, len(token), False
    while i < n:
        c = token[i]
        j = i + 1
        while j < n and token[j] == c:
            j += 1
        k = j - i
        letters = [c] if c in _INDEX else list(LOOK_ALIKES.get(c, ""))
        pieces: tuple[str, ...] = ()
        if letters:
            # three or more alike are a stretched single or double letter; one or two stay
            pieces = tuple(x * m for x in letters for m in ((1, 2) if k > 2 or single and k == 2 else (k,)))
        elif c.isalpha():
            pieces = (c * k,)
        if pieces:
            slots.append(pieces + tuple(" " + x for x in pieces) if breaks and apart and slots else pieces)
        i = j  # other signs inside a token are separators
        apart = not pieces
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for slot in slots:
        ahead: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for piece in slot:
                x, y, s = a, b, score
                for ch in piece:
                    z = _INDEX.get(ch, 0)
                    s += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in ahead or s > ahead[x, y][0]:
                    ahead[x, y] = (s, (path, piece))
        states = ahead
    path = max(((s + float(model[a, b, 0]), p) for (a, b), (s, p) in states.items()), key=lambda t: t[0])[1]
    out = []
    while path:
        path, piece = path
        out.append(piece)
    return "".join(reversed(out))


def restored_words(token: str, model: np.ndarray) -> tuple[str, ...]:
    """Words of one white-space token: as written, and as decoded where it looks disguised."""
    low = token.lower()
    plain = tuple(_WORD.findall(low))
    doubled = sum(1 for _ in _DOUBLED.finditer(low)) > 1
    if _PLAIN.fullmatch(low) and not doubled and not _REPEAT.search(low):
        return plain
    core = low.strip(_TRIM)
    if not any(c.isalpha() for c in core) and not any(c in LOOK_ALIKES for c in core):
        return plain
    out = dict.fromkeys(plain)
    for form in {core, core.rstrip("!*+$#%|"), core.strip("!*+$#%|(<0123456789")}:
        if form and any(c.isalpha() for c in form):
            out[decode(form, model)] = None
            parts = _PART.findall(form)
            if len(parts) > 1:
                out.update(dict.fromkeys(decode(form, model, breaks=True).split()))
                for part in parts:  # words without a disguise are in plain
                    if len(part) > 2 and not part.isalpha() and any(map(str.isalpha, part)):
                        out[decode(part, model)] = None
            if doubled:
                for part in parts:
                    out[decode(part, model, single=True)] = None
                    runs = [m.group() for m in _RUN.finditer(part)]
                    if not any(len(r) % 2 for r in runs):
                        out[decode("".join(r[: len(r) // 2] for r in runs), model)] = None
    return tuple(w for w in out if w)


def _step(state: tuple[int, int], piece: str, model: np.ndarray) -> tuple[tuple[int, int], float]:
    x, y = state
    s = 0.0
    for ch in piece:
        z = _INDEX.get(ch, 0)
        s += float(model[x, y, z])
        x, y = y, z
    return (x, y), s


def likely_words(units: list[str], model: np.ndarray, margin: float) -> set[str]:
    """Words of all paths through a spaced run that are at most ``margin`` (log) less
    likely than the best one; each gap is an optional word break."""
    slots = []
    for m in _RUN.finditer("".join(units)):
        letters, k = LOOK_ALIKES.get(m[1], m[1]), m.end() - m.start()
        slots += [tuple(x * j for x in letters for j in (1, 2))] if k > 2 else [tuple(letters)] * k
    n = len(slots)
    before: list[dict] = [{(0, 0): 0.0}]  # best score of a path to a state, by number of slots passed
    for i, slot in enumerate(slots):
        ahead: dict[tuple[int, int], float] = {}
        for state, s in before[i].items():
            for piece in slot:
                for lead in ("", " ") if i else ("",):
                    to, more = _step(state, lead + piece, model)
                    ahead[to] = max(ahead.get(to, -math.inf), s + more)
        before.append(ahead)
    after: list[dict] = [{} for _ in slots] + [{st: float(model[st[0], st[1], 0]) for st in before[n]}]  # best score from a state to the end
    broken: list[dict] = [{} for _ in slots] + [after[n]]  # the same, with a break at once
    for i in range(n - 1, -1, -1):
        for st in before[i]:
            go = {lead: max(more + after[i + 1][to] for to, more in (_step(st, lead + piece, model) for piece in slots[i])) for lead in (("", " ") if i else ("",))}
            after[i][st], broken[i][st] = max(go.values()), go.get(" ", -math.inf)
    least = after[0][0, 0] - margin
    out = set()
    for p in range(n):
        paths: dict[tuple[int, int], tuple[float, str]] = {}
        for st, s in before[p].items():
            to, more = _step(st, " ", model) if p else (st, 0.0)
            paths[to] = max(paths.get(to, (-math.inf, "")), (s + more, ""))
        for q in range(p, n):
            if q - p == LONGEST:
                out.update(word for _, word in paths.values())
                break
            ahead = {}
            for st, (s, word) in paths.items():
                for piece in slots[q]:
                    to, more = _step(st, piece, model)
                    if s + more + after[q + 1][to] >= least:
                        ahead[to] = max(ahead.get(to, (-math.inf, "")), (s + more, word + piece))
            paths = ahead
            if not paths:
                break
            out.update(word for st, (s, word) in paths.items() if s + broken[q + 1][st] >= least)
    return out


def spaced_words(run: str, model: np.ndarray) -> set[str]:
    """Words of a run of single letters: without a break, with breaks where they are
    likely, and with breaks where the separator is not the run's usual one."""
    run = run.lower()
    units, gaps = [run[0]], []
    for m in _UNIT.finditer(run, 1):
        gaps.append(m[1])
        units.append(m[2])
    out = {decode("".join(units), model), *likely_words(units, model, MARGIN)}
    usual = Counter(gaps).most_common(1)[0][0]
    if any(g != usual for g in gaps):
        words = units[0] + "".join(("" if g == usual else " ") + u for g, u in zip(gaps, units[1:]))
        out.update(decode(w, model) for w in words.split())
    return out


class Restorer:
    """Words of a restored text, with a bounded memo of tokens."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.memo = Memo(lambda t: restored_words(t, model), 200_000)

    def words(self, text: str) -> set[str]:
        out: set[str] = set()
        for w in map(self.memo.__getitem__, set(text.split())):
            out.update(w)
        for m in _SPACED.finditer(text):
            out.update(spaced_words(m.group(), self.model))
        out.discard("")
        return out


def features(word: str) -> list[str]:
    """The whole word (marked) and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if k < len(word))]


# ---- fitting ----------------------------------------------------------------------------


def _feature_counts(batches, model, known):
    restore, only = Restorer(model.value), known and known.value
    memo = Memo(lambda w: [f for f in features(w) if not only or f in only], 200_000)
    counts = ({}, Counter(), Counter())
    for b in batches:
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got: set[str] = set()
            for w in restore.words(text or ""):
                got.update(memo[w])
            counts[1 + toxic].update(got)
    for toxic in (0, 1):
        c = counts[1 + toxic]
        yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["toxic", "f", "n"])


def _incidence(batches, model, known):
    restore, only = Restorer(model.value), known.value
    for b in batches:
        got = [sorted({f for w in restore.words(t or "") for f in features(w) if f in only}) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string()))], ["f"])


def wilson(k: int, n: int, z: float = 1.28) -> float:
    """Lower end of the Wilson interval of k of n."""
    if not n:
        return 0.0
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(labelled: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> dict[str, float]:
    """labelled: doc_id, text, toxic (0/1, not null). Returns rule -> weight."""
    spark = labelled.sparkSession
    chosen = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.col("toxic").cast("int"), "text")
    # equal texts say a thing once; a text is compared by its hash and length
    rows = rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")
    sent = spark.sparkContext.broadcast(model)
    toxic = rows.filter("toxic = 1")
    seen = (
        arrow_stage(toxic, functools.partial(_feature_counts, model=sent, known=None), "toxic int, f string, n long")
        .groupBy("f").agg(F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "f").limit(10 * FEATURES).collect()
    )
    if not seen:
        return {}
    known = spark.sparkContext.broadcast({r.f for r in seen})  # at most 10 x FEATURES
    clean = {
        r.f: r.n for r in arrow_stage(rows.filter("toxic = 0"), functools.partial(_feature_counts, model=sent, known=known), "toxic int, f string, n long")
        .groupBy("f").agg(F.sum("n").alias("n")).collect()
    }
    weight = {r.f: wilson(r.n, r.n + clean.get(r.f, 0)) for r in seen}
    strong = sorted((f for f in weight if weight[f] >= 0.6), key=lambda f: (-weight[f], f))[:FEATURES]
    counted = {r.f: r.n for r in seen}
    kept = spark.sparkContext.broadcast(set(strong))
    left = [set(r.f) for r in arrow_stage(toxic, functools.partial(_incidence, model=sent, known=kept), "f array<string>").collect()]
    return cover(left, {f: (weight[f], counted[f], clean.get(f, 0)) for f in strong})


def cover(left: list[set[str]], stats: dict[str, tuple[float, int, int]], rules: int = RULES) -> dict[str, float]:
    """Weighted covering: take the rule that explains most of the toxic documents, less
    what it would accuse wrongly; a document that k rules explain weighs 1/(1+k), so
    several rules of one document can be found. Of equally good rules the longer one is
    taken. Stop when a rule explains less than `LEAST_GAIN` documents' weight."""
    out: dict[str, float] = {}
    weight = [1.0] * len(left)
    gain: Counter = Counter()
    for s in left:
        gain.update(s)
    while gain and len(out) < rules:
        best = max(gain, key=lambda f: (round(gain[f], 6) - 3 * stats[f][2], stats[f][0], f[0] == "=", len(f), f))
        if gain.pop(best) - 3 * stats[best][2] < LEAST_GAIN:
            break
        out[best] = stats[best][0]
        for k, s in enumerate(left):
            if best in s:
                # beginnings and continuations of the same word say nothing new here
                nested = {f for f in s if f != best and (f.strip("=").startswith(best.strip("=")) or best.strip("=").startswith(f.strip("=")))}
                for f in nested:
                    gain[f] -= weight[k]
                s -= nested
                new = weight[k] / (1 + weight[k])  # 1, 1/2, 1/3, ...
                for f in s:
                    if f in gain:
                        gain[f] -= weight[k] - new
                weight[k] = new
    return out


# ---- scoring ----------------------------------------------------------------------------


class Scorer:
    """Scores whole texts by the rules: the largest weight among the words of their tokens and spaced runs.

    Most disguised tokens cannot be read as any rule. Before a token is decoded, its lattice, with every
    sign, run length and beginning that a reading may use, is walked against the beginnings of the rules;
    only where some path reaches a rule does Viterbi say which reading is the likeliest."""

    def __init__(self, rules: dict[str, float], model: np.ndarray) -> None:
        self.rules, self.model = rules, model
        names = {f.lstrip("=") for f in rules}
        self.begun = {f[:k] for f in names for k in range(1, len(f) + 1)}
        self.names, self.longest = names, max(map(len, names), default=0)
        self.heads = {f[:3] for f in names}  # a rule of under three letters is a whole word: its own head
        self.memo = Memo(self.token, 200_000)

    def word(self, word: str) -> float:
        if word[:3] not in self.heads:
            return 0.0
        return max(self.rules.get(f, 0.0) for f in features(word))

    def reaches(self, low: str) -> bool:
        """Whether some reading of a lower-case token may begin with a rule."""
        states: set[str] = set()
        fresh = True
        for m in _RUN.finditer(low):
            c = m[1]
            letters = c if c in _INDEX else LOOK_ALIKES.get(c) or (c if c.isalpha() else "")
            if letters:
                if fresh:
                    states.add("")
                often = range(1, min(m.end() - m.start(), self.longest) + 1)
                states = {t for x in letters for j in often for s in states if (t := s + x * j) in self.begun}
                if not states.isdisjoint(self.names):
                    return True
            fresh = not c.isalpha()
        return False

    def token(self, token: str) -> float:
        low = token.lower()
        plain = max(map(self.word, _WORD.findall(low)), default=0.0)
        if low.isalpha() and not _DOUBLED.search(low) or not self.reaches(low):
            return plain
        return max(plain, max(map(self.word, restored_words(token, self.model)), default=0.0))

    def __call__(self, text: str | None) -> float:
        if not text or not self.rules:
            return LEAST_SCORE
        best = LEAST_SCORE
        for t in text.split():
            s = self.memo[t] if len(t) <= LONGEST else self.token(t)
            if s > best:
                best = s
        for m in _SPACED.finditer(text):
            best = max(best, max(map(self.word, spaced_words(m.group(), self.model)), default=0.0))
        return best


def _scorer(rules: dict[str, float], model: np.ndarray) -> Scorer:
    return Scorer(rules, model)


def _score(batches, sent):
    score = _scorer(*sent.value)
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"]
        )


def score(docs: DataFrame, rules: dict[str, float], model: np.ndarray) -> DataFrame:
    """doc_id, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((rules, model))  # RULES entries, _BASE**3 floats
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs.select("doc_id", "text"), functools.partial(_score, sent=sent), f"doc_id {kind}, score double")


def _keep(batches, sent, text_at):
    score = _scorer(*sent.value)
    for b in batches:
        yield b.filter(pa.array([score(t) < THRESHOLD for t in b.column(text_at).to_pylist()], pa.bool_()))


def drop_toxic(docs: DataFrame, rules: dict[str, float], model: np.ndarray) -> DataFrame:
    """``docs`` with all its columns, without the rows that score THRESHOLD or more."""
    sent = docs.sparkSession.sparkContext.broadcast((rules, model))
    return arrow_stage(docs, functools.partial(_keep, sent=sent, text_at=docs.columns.index("text")), docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the documents that labels may be learned from
    (crc32 of the id as text, modulo 3, is not 1)."""
    said = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 != 1")
    return docs.select("doc_id", "text").join(said.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
