"""Secret scans: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order models over characters are trained on labelled samples, one on random strings and
one on ordinary identifiers and words. Inside each run of key characters that no fixed pattern covers, the stretch
with the largest sum of log-likelihood ratios is a secret when that sum passes a threshold: under the ordinary
model the largest sum among n characters exceeds x with a probability of about n exp(-x), so the threshold is log n
and a margin, which is set on the ordinary samples that were held out. So words around a key don't hide it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_or_empty

# The patterns of the base spans and the least length of what they must hold.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: What the Markov models judge: runs of key characters. A stretch has so many characters at least, and so many
#: different ones (rulers and repetitions have fewer).
LEAST, DISTINCT = 12, 8
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What is written like a word must be so long to be judged; rare words of 12 letters can look as random as keys.
WORD, WORD_LEAST = re.compile(r"[A-Za-z][a-z]*"), 20
#: What parts the words of a run.
SEPARATORS = "_-/+="

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_AT = {c: i for i, c in enumerate(ALPHABET)}
_CODES = np.zeros(128, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

# Ordinary words, for the sample of ordinary identifiers.
WORDS = """
the and for with from that this have will which there their would about other into time people than only over also
after first well year because good these most state between never under last while might great school house world
every another much before right mean same tell boy follow came want show form small end does large must even such
user name value index count list item node table column row file path data type class method function object string
number array map key result error message request response server client session service handler manager factory
config option default version build test example common local remote public private static final abstract interface
get set add remove update delete create find load save open close read write start stop run init parse format
que los las una con por para como mas pero sus este entre cuando muy sin sobre tambien hasta desde todo nos durante
les des est dans pour qui sur pas plus par avec tout nous vous fait comme mais leur bien deux sont cette etre autre
der die und den von das mit sich des auf ist nicht ein eine als auch nach wie werden wird zum haben einer aus bei
vervoll geschaft heiten lichkeit ungen schen tionen ement aison cion mente adores ation ness able ible ering tion
"""


def ordinary_samples(n: int, seed: int = 1) -> list[str]:
    """Identifiers, paths and long words made of ordinary words."""
    rng, words = random.Random(seed), WORDS.split()
    out = []
    for _ in range(n):
        some = [rng.choice(words) for _ in range(rng.randint(3, 7))]
        kind = rng.randrange(8)
        if kind == 0:
            out.append(some[0] + "".join(w.title() for w in some[1:]))
        elif kind == 1:
            out.append("_".join(some))
        elif kind == 2:
            out.append("-".join(some))
        elif kind == 3:
            out.append("/".join(some))
        elif kind == 4:
            out.append("".join(some))
        elif kind == 5:
            out.append("".join(some).upper() if rng.random() < 0.5 else "_".join(some).upper())
        elif kind == 6:
            out.append("".join(some).title())
        else:
            out.append("_".join(some) + rng.choice(["", "_", "-"]) + str(rng.randint(0, 2030)))
    return out


def random_samples(n: int, seed: int = 2) -> list[str]:
    """Strings drawn evenly from the alphabets in which keys are written."""
    rng = random.Random(seed)
    sets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", ALPHABET[:62] + "-_"]
    return ["".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64))) for _ in range(n)]


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of first characters and of steps between characters, and what a stretch must have beyond the log of its run's length."""

    first: np.ndarray
    step: np.ndarray
    margin: float

    def sums(self, run: str) -> np.ndarray:
        """The sum of ratios before each place of a run."""
        at = _CODES[np.frombuffer(run.encode("ascii"), np.uint8)]
        return np.concatenate(([0.0], np.cumsum(np.concatenate((self.first[at[:1]], self.step[at[:-1], at[1:]])))))

    def best(self, run: str) -> tuple[float, int, int]:
        """(sum of ratios, start, end) of the stretch with the largest sum."""
        sums = self.sums(run)
        low = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - low))
        return float(sums[end] - low[end]), int(np.argmin(sums[: end + 1])), end

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """The stretches of a run that are secrets, in order; none overlap.

        Each begins as the best stretch and is drawn out to the separators around it, on both sides or else on one, while its sum passes the threshold:
        the ends of a key may look like words, and none of it is to stay readable.
        """
        found, todo = [], [(0, len(run))]
        while todo:
            a, b = todo.pop()
            if b - a < LEAST:
                continue
            part = run[a:b]
            total, s, e = self.best(part)
            least = math.log(b - a) + self.margin
            if total < least:
                continue
            left = max((part.rfind(c, 0, s) for c in SEPARATORS), default=-1) + 1
            right = min((k for c in SEPARATORS if (k := part.find(c, e)) >= 0), default=len(part))
            sums = self.sums(part)
            wide = [(x, y) for x, y in ((left, right), (left, e), (s, right)) if sums[y] - sums[x] >= least]
            s, e = max(wide, key=lambda w: w[1] - w[0], default=(s, e))
            if e - s >= LEAST and len(set(part[s:e])) >= DISTINCT and (e - s >= WORD_LEAST or not WORD.fullmatch(part, s, e)):
                found.append((a + s, a + e))
            todo += [(a, a + s), (a + e, b)]
        return sorted(found)


def _counted(samples: Iterable[str], smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(ALPHABET)
    first, step = np.full(n, smoothing), np.full((n, n), smoothing)
    for s in samples:
        at = [_AT[c] for c in s if c in _AT]
        if at:
            first[at[0]] += 1
            np.add.at(step, (at[:-1], at[1:]), 1)
    return np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True))


def train(labelled: Iterable[tuple[str, int]], smoothing: float = 0.5, slack: float = 4.0) -> MarkovPair:
    """labelled: (string, 1 if random else 0). Each fifth ordinary string is held out; the margin is the largest sum beyond the log of the length among them, and slack."""
    labelled = list(labelled)
    ordinary = [s for s, y in labelled if y == 0]
    held, ordinary = ordinary[::5], [s for k, s in enumerate(ordinary) if k % 5]
    f1, s1 = _counted((s for s, y in labelled if y == 1), smoothing)
    f0, s0 = _counted(ordinary, smoothing)
    pair = MarkovPair(f1 - f0, s1 - s0, 0.0)
    return MarkovPair(pair.first, pair.step, slack + max((pair.best(s)[0] - math.log(len(s)) for s in held if RUN.fullmatch(s)), default=0.0))


def default_model(n: int = 8000) -> MarkovPair:
    """Trained on n random and n ordinary samples."""
    return train([*((s, 0) for s in ordinary_samples(n)), *((s, 1) for s in random_samples(n))])


def scan(text: str, model: MarkovPair) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start, then kind as listed: assign, access, hex, markov. Time is linear in the text."""
    spans = []
    lowered = text.lower()
    if any(w in lowered for w in ("passw", "secret", "token", "api_key", "apikey")):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = sorted(spans)
    at = 0  # spans before it end before the run
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][1] <= a:
            at += 1
        free, k = [], at
        while a < b:  # the parts of the run between base spans
            s, e = (base[k][0], base[k][1]) if k < len(base) and base[k][0] < b else (b, b)
            if a < s:
                free.append((a, s))
            a, k = max(a, e), k + 1
        for s, e in free:
            spans += [(s + x, s + y, 3) for x, y in model.stretches(text[s:e])]
    names = ("assign", "access", "hex", "markov")
    return [(s, e, names[k]) for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1]))]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """One row for each document: id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Whole texts are scanned; null counts as empty and has no spans. Spans of different kinds may overlap,
    but a markov span overlaps no other. Repeated rows are repeated; other columns are not looked at. With the default model, even random
    keys of letters and digits are covered whole in 95 % of cases from 12 characters on and in 99 % from 16 on, in a path or alone; those with
    separators in them (base64) in 95 %; those written like a word, one letter case and no digit, only from 20 characters on.
    """
    model = model or default_model()

    def run(batches):
        for batch in batches:
            found = [scan(t, model) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, _, k in spans) for spans in found], pa.int64()) for kind in ("assign", "access", "hex", "markov")]
            base = [hashlib.sha256(_joined([x for x in spans if x[2] != "markov"]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(list(map(_joined, found)), pa.string())], names=["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    out = df.select(df[id_col].cast("long").alias("id"), text_or_empty(df, text_col).alias("text"))
    return out.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
