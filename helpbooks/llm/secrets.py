"""Secret scan: fixed patterns, plus a guess-cost estimate of credential values.

Base kinds are the leftmost non-overlapping matches of three patterns, a match
being dropped if it is too short. The method adds kind ``guess``: values in a
credential context (a wider list of key names, a wider value alphabet) whose
cheapest explanation takes at least 10**``min_log10`` guesses. That cost is a
dynamic programme over the value: the cheapest way to cut it into dictionary
words (also reversed, or with digits for letters), dates, repeats of up to
``LONGEST_UNIT`` letters, keyboard walks and brute-force runs, every sub-span of
each being tried. A separator between two segments tells the attacker the cut, so it costs
its own choice alone. Words are ranked by a public vocabulary file, whose path is
a parameter.

Spans are whole matches, in code points, the end exclusive. A null text is
empty and has no spans. Every text, and every value, is taken whole however long
it is; equal rows give equal results; an empty table gives no rows; only
``doc_id`` and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so a least length and dropping short runs are the same
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]

#: Words that only such values are near; a text without any of them has no context.
HINTS = ("pass", "secret", "token", "key", "pwd", "credential", "auth")
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:bearer\x20+)?(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>,;]{6,}))""", re.I | re.A)
MIN_LOG10 = 10.0

#: Byte-pair vocabulary whose merge order ranks words, the commonest first; None leaves WORDS alone.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that passwords and placeholders use, ranked before all others.
WORDS = tuple(
    "password secret admin welcome letmein monkey dragon login master hello qwerty shadow sunshine princess football baseball iloveyou "
    "trustno default changeme change test guest user root pass token example sample dummy placeholder your my the key api access private public "
    "server client service system database data local host mail email company summer winter spring autumn love star super magic flower freedom "
    "computer internet security secure mobile phone manager account staff temp demo none null true false this that with from here value string "
    "insert enter replace fill todo redacted hidden masked removed config setting settings process env environ field name production staging development prod stage".split()
)
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
_LEET = str.maketrans("@0$1!3457", "aosiieast")


def _steps() -> set[str]:
    return {a + b for row in ROWS for pair in (row, row[::-1]) for a, b in zip(pair, pair[1:], strict=False)}


STEPS = _steps()


def alphabet(value: str) -> int:
    """Size of the alphabet that a brute-force attack on the value needs."""
    n = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    return n + 33 * any(not c.isalnum() and c.isascii() for c in value) + 100 * any(not c.isascii() for c in value) or 10


def word_cost(value: str, ranks: dict[str, int]) -> float | None:
    """log10 of guesses of a dictionary word, read forwards, backwards or with letters for look-alike signs; None if it is none."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    swapped = sum(a != b for a, b in zip(low, plain, strict=True))
    upper = sum(c.isupper() for c in value)
    case = (math.log10(2) if upper else 0) + (math.log10(len(value)) if 1 < upper < len(value) else 0)
    options = [(low, 0.0), (low[::-1], math.log10(2)), (plain, math.log10(2) * (1 + swapped))]
    return min((math.log10(ranks[w] + 1) + case + more for w, more in options if w in ranks), default=None)


def date_cost(value: str) -> float | None:
    """log10 of guesses of a year, month or day."""
    return None if not DATE.fullmatch(value) else math.log10(119) if len(value) == 4 else math.log10(365.25 * 119)


def unit_cost(unit: str) -> float:
    """log10 of guesses of what a repeat repeats."""
    return len(unit) * math.log10(alphabet(unit))


#: A walk's first key; each further key is a step one way or back. Each further copy of a repeat.
WALK, STEP, AGAIN = math.log10(len(ROWS) * 20), math.log10(2), 0.1
LEAST_SPAN = 3
#: Letters of the longest unit of a repeat; longer ones cost more than any threshold by brute force, and words are words in them too.
LONGEST_UNIT = 32
#: Every further segment: the attacker must also guess the cut.
CUT = 1.0
#: Signs that part words in names and placeholders; one between two segments is guessed instead of a cut.
SEPARATORS = "_-./: "
SEPARATOR = math.log10(len(SEPARATORS))
#: log10 of guesses from which on no more is asked of a value (each letter adds to the cost, so the longest values end soon).
ENOUGH = 64.0


def guess_cost(value: str, ranks: dict[str, int] | None = None, enough: float = math.inf) -> tuple[float, list[tuple[int, int, str]]]:
    """(log10 of guesses, the segments): the cheapest segmentation of the value. A brute-force run costs one alphabet factor a character.

    Walks and repeats grow by a letter or a unit, so every sub-span of them is tried in one pass. A value that certainly
    takes ``enough`` guesses gets that cost and no segments.
    """
    ranks = RANKS if ranks is None else ranks
    n, longest, each = len(value), max(map(len, ranks), default=0), math.log10(alphabet(value))
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, back = low.translate(_LEET), low[::-1]

    def ending(j: int) -> Iterator[tuple[int, str, float]]:
        for i in range(max(0, j - longest), j - LEAST_SPAN + 1):
            if low[i:j] in ranks or plain[i:j] in ranks or back[n - j : n - i] in ranks:
                yield i, "word", word_cost(value[i:j], ranks)
        if value[j - 1].isdigit():
            for i in range(max(0, j - 10), j - 3):
                if value[i].isdigit() and (cost := date_cost(value[i:j])) is not None:
                    yield i, "date", cost

    none = (math.inf, None)
    # up to j: the last segment being explained, a brute-force run, a walk, a repeat by its unit's length
    explained, brute, walk, repeat = [(0.0, None)], [none], [none], {p: {} for p in range(1, LONGEST_UNIT + 1)}
    parted = [math.inf]  # up to j, whose last letter is a separator
    steps, same = 1, [0] * (LONGEST_UNIT + 1)
    above, reach = 0, max(longest, 2 * LONGEST_UNIT)  # a segment that is not yet seen at j starts no further back

    def opened(i: int) -> float:
        return min(min(explained[i][0], brute[i][0]) + (CUT if i else 0.0), parted[i])

    for j in range(1, n + 1):
        options = [(opened(i) + cost, (i, kind)) for i, kind, cost in ending(j)]
        steps = steps + 1 if low[j - 2 : j] in STEPS else 1
        grown = (walk[j - 1][0] + STEP, walk[j - 1][1]) if steps > LEAST_SPAN else none
        fresh = (opened(j - LEAST_SPAN) + WALK + STEP * (LEAST_SPAN - 1), (j - LEAST_SPAN, "walk")) if steps >= LEAST_SPAN else none
        walk.append(min(grown, fresh, key=lambda x: x[0]))
        options.append(walk[j])
        for p in range(1, min(LONGEST_UNIT, j - 1) + 1):
            same[p] = same[p] + 1 if low[j - 1] == low[j - 1 - p] else 0
            copies = max(2, -(-LEAST_SPAN // p))
            if same[p] >= p:
                before = repeat[p].get(j - p, none)
                best = (before[0] + AGAIN, before[1])
                i = j - copies * p
                if same[p] >= (copies - 1) * p:
                    best = min(best, (opened(i) + unit_cost(value[i : i + p]) + AGAIN * (copies - 1), (i, "repeat")), key=lambda x: x[0])
                if best[1]:
                    repeat[p][j] = best
                    options.append(best)
        explained.append(min(options, key=lambda x: x[0]))
        parted.append(min(explained[j - 1][0], brute[j - 1][0]) + SEPARATOR if j > 1 and value[j - 1] in SEPARATORS else math.inf)
        longer, start = brute[j - 1][0] + each, min(explained[j - 1][0] + (CUT if j > 1 else 0.0), parted[j - 1]) + each
        brute.append((longer, brute[j - 1][1]) if longer <= start else (start, (j - 1, "brute")))
        above = above + 1 if min(explained[j][0], brute[j][0]) >= enough else 0
        if above > reach:
            return enough, []
    cuts, j = [], n
    while j:
        i, kind = min(explained[j], brute[j], key=lambda x: x[0])[1]
        cuts.append((i, j, kind))
        j = i
        if i and parted[i] < min(explained[i][0], brute[i][0]) + CUT:
            cuts.append((i - 1, i, "separator"))
            j = i - 1
    return min(explained[n][0], brute[n][0]), cuts[::-1]


def ranked(words: list[str] | tuple[str, ...]) -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(x.lower() for x in words))}


def vocabulary_words(path: str) -> list[str]:
    """The words of at least three letters of a byte-pair vocabulary (a base64 token and its rank a line), in the order of ranks."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip() for line in f]
    return [t for t in tokens if len(t) >= LEAST_SPAN and t.isascii() and t.isalpha()]


RANKS = ranked(WORDS)


def scan(text: str, ranks: dict[str, int] | None = None, min_log10: float = MIN_LOG10) -> list[tuple[int, str, int, float | None]]:
    """All spans of a text as (start, kind, end, log10 guesses), in order."""
    low = text.lower()
    hints = any(h in low for h in HINTS)
    out: list[tuple[int, str, int, float | None]] = []
    if hints:
        out += [(m.start(), "assign", m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), "hex", m.end(), None) for m in HEX.finditer(text)]
    if hints:
        for m in CONTEXT.finditer(text):
            at = m.lastindex
            cost = guess_cost(m[at], ranks, ENOUGH)[0]
            if cost >= min_log10:
                out.append((m.start(at), "guess", m.end(at), cost))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_log10_guesses double"


def find(docs: DataFrame, vocabulary: str | None = VOCABULARY, min_log10: float = MIN_LOG10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document; columns as in ``SCHEMA``. No shuffle: every text is scanned where it is read. The driver alone reads the vocabulary."""
    common.small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(ranked([*WORDS, *vocabulary_words(vocabulary)]) if vocabulary else RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in common.strings(batch.column(1)):
                spans = scan(t, shipped.value, min_log10)
                n = {k: sum(s[1] == k for s in spans) for k in KINDS}
                base = joined([s for s in spans if s[1] != "guess"])
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans), n["guess"], max((s[3] for s in spans if s[3] is not None), default=None)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text")).mapInArrow(run, SCHEMA)
