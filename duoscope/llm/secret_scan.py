"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import map_texts

#: The base patterns, in the order in which their kinds sort, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

#: Parts of ordinary identifiers, paths and words.
IDENTIFIER_PARTS = (
    "account action address admin agent alpha annotation application archive argument array assert asset attribute author "
    "balance base batch begin binary block boolean border branch broker browser buffer build button bytes cache callback "
    "cancel capture category center channel character check child class clear client clone cluster code collect color column "
    "command comment commit common compare component compute config connect console constant container content context "
    "control convert cookie copy count country create current cursor custom data database date debug default delete delta "
    "deploy detail device dialog dict digest directory disable dispatch display document domain double download draft driver "
    "duration edit element email empty enable encode engine entity entry environment error event example exception execute "
    "export extension external factory failure feature field file filter final find first float folder font footer format "
    "forward frame function gateway generate global graph group handle hash header height hidden history host icon image "
    "import include index info init input insert instance integer interface internal invoice item iterator join json kernel "
    "label language last layer layout length level library license limit line link list listener load local locale location "
    "lock logger login main manager manifest map margin master match matrix memory menu merge message metadata method metric "
    "middle mobile model module monitor mount name native network next node normal notice number object offset open operator "
    "option order origin output owner package page panel parameter parent parse part partition password patch path pattern "
    "payment pending person phone pipeline pixel platform plugin point policy pool port position prefix preview previous "
    "primary print private process product profile program project property protocol provider proxy public query queue random "
    "range read record redirect reference refresh region register release remote remove render report request reset resource "
    "response result return role root route row rule runtime sample scale schedule schema scope score screen script scroll "
    "search section segment select sender sequence server service session setting shader shadow share shell signal simple "
    "size snapshot socket source space special spline stack stage standard start state static status step storage store "
    "stream string style submit success suffix support switch symbol sync syntax system table target task template temp "
    "tenant test text theme thread time timeout title token toggle tool topic trace track transaction transform transport "
    "tree trigger tuple type unit update upload user util valid value variable vector vendor version vertex view visible "
    "volume wait warning watch web weight widget width window worker wrapper write xml year zone "
    "aber auch dass eine einer haben heit keit lich nicht schaft ung werden avec cette comme dans elle entre leur mais "
    "ment nous pour tion como desde donde entre esta mente para pero porque sobre with from that this which tion ing ness"
).split()
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: The least length of a part that is scored, and what stands between parts.
MIN_PART = 16
_SYMBOLS = string.ascii_letters + string.digits + "+/_.=-"
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_DELIMITER = np.zeros(128, bool)
_DELIMITER[[ord(c) for c in "+/_.=-"]] = True


def random_samples(n: int, seed: int) -> list[str]:
    """Labelled 1: strings drawn at random over the alphabets of keys, tokens and digests."""
    r = random.Random(seed)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.hexdigits.lower()[:16], string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    return ["".join(r.choices(r.choice(alphabets), k=r.randint(16, 64))) for _ in range(n)]


def identifier_samples(n: int, seed: int) -> list[str]:
    """Labelled 0: identifiers, paths, dotted names, run-together words, versions and dates."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        parts = r.choices(IDENTIFIER_PARTS, k=r.randint(2, 6))
        style = r.randrange(8)
        if style == 1:
            parts = [p.capitalize() for p in parts]
        elif style == 2:
            parts = [parts[0], *(p.capitalize() for p in parts[1:])]
        elif style == 3:
            parts = [p.upper() for p in parts]
        s = ["_", "", "", "_", "/", ".", "-", ""][style].join(parts)
        if r.random() < 0.15:
            s += r.choice(["", "_", "-"]) + str(r.randint(0, 2030))
        elif r.random() < 0.05:
            s += f"-{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"
        elif r.random() < 0.05:
            s = r.choice("-=_.") * r.randint(16, 80)
        out.append(s)
    return out


def joined_samples(samples: list[str], seed: int) -> list[str]:
    """The samples behind an ordinary identifier or path, as in settings and webhook addresses."""
    r = random.Random(seed)
    return [p + r.choice("=/_.-") + s for p, s in zip(identifier_samples(len(samples), seed + 1), samples, strict=True)]


class Markov:
    """log P(random) - log P(identifier) of first-order character chains, per step; and the threshold."""

    def __init__(self, n: int = 20_000, seed: int = 11, passed: float = 0.0005, missed: float = 0.01) -> None:
        """Trained on n labelled samples of either kind.

        The threshold is the highest that misses `missed` of n other random strings, half of them behind an ordinary
        prefix, or, where more than `passed` of n other identifiers, as many of them joined ones, would get over it, the
        one that these leave. A string's best part counts (see best()).
        """
        size = len(_SYMBOLS)
        chain = []
        for samples in (random_samples(n, seed), identifier_samples(n, seed + 1)):
            counts = np.full((size, size), 0.5)
            for s in samples:
                c = _CODE[np.frombuffer(s.encode(), np.uint8)]
                np.add.at(counts, (c[:-1], c[1:]), 1)
            chain.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        self.ratio = chain[0] - chain[1]
        plain, keys = identifier_samples(n, seed + 2), random_samples(n, seed + 3)
        half = n // 2
        other = [self.best(s) for s in plain[:half] + joined_samples(plain[half:], seed + 4) if len(s) >= MIN_PART]
        drawn = [self.best(s) for s in keys[:half] + joined_samples(keys[half:], seed + 6)]
        self.threshold = max(0.0, float(np.quantile(other, 1 - passed)), float(np.quantile(drawn, missed)))

    def score(self, s: str) -> float:
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        return float(self.ratio[c[:-1], c[1:]].mean())

    def _parts(self, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running sums of the log ratios up to each character, and where parts may start and end (the last character)."""
        raw = np.frombuffer(s.encode(), np.uint8)
        c, mark = _CODE[raw], _DELIMITER[raw]
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[c[:-1], c[1:]])])
        edge = np.ones(1, bool)
        return sums, np.concatenate([edge, mark[:-1]]), np.concatenate([mark[1:], edge])

    def best(self, s: str) -> float:
        """The highest score of the whole string and of its parts between delimiters, of MIN_PART characters or more."""
        sums, start, end = self._parts(s)
        a, b = np.nonzero(start)[0], np.nonzero(end)[0]
        steps = b[None, :] - a[:, None]
        ok = steps >= MIN_PART - 1
        return float(((sums[b][None, :] - sums[a][:, None])[ok] / steps[ok]).max()) if ok.any() else self.score(s)

    def found(self, s: str) -> bool:
        """best(s) > threshold for MIN_PART characters or more, in one pass: a part's sum less threshold * steps is positive."""
        sums, start, end = self._parts(s)
        over = sums - self.threshold * np.arange(len(sums))
        least = np.minimum.accumulate(np.where(start, over, np.inf))[: len(over) - MIN_PART + 1]
        return bool((end[MIN_PART - 1 :] & (over[MIN_PART - 1 :] > least + 1e-9)).any())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, leftmost and non-overlapping within a kind; those too short are dropped."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX] if _LONG_HEX.search(text) else []
    return sorted(out)


_LONG_HEX = re.compile(r"[0-9a-f]{32}")


def scan(text: str | None, model: Markov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the model's: what base spans leave of each candidate, if a part of it is above the threshold.

    Base spans and candidates both come in order, so one sweep meets them.
    """
    text = text or ""
    base = base_spans(text)
    more, first = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while first < len(base) and base[first][2] <= a:
            first += 1
        at, i = a, first
        while i < len(base) and base[i][0] < b:
            s, _, e = base[i]
            if s - at >= MIN_PART and model.found(text[at:s]):
                more.append((at, 3, s))
            at = max(at, e)
            i += 1
        if b - at >= MIN_PART and model.found(text[at:b]):
            more.append((at, 3, b))
    return base, more


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_samples: int = 20_000, seed: int = 11) -> DataFrame:
    """Secrets, a row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A span is kind:start:end over code points, end exclusive, of the whole match; spans sort by start, then kind.
    base_sha256 digests the joined base spans (of the empty string without any); spans holds the model's as "markov" too.
    The two chains are trained on the driver from n_samples generated, labelled strings of either kind: a table of
    68 * 68 numbers goes to the executors, however large the input. A null text is empty. Rows are independent: no
    shuffle. An empty table gives an empty result; a text is scanned whole, in time linear in its length. A candidate that
    base spans touch is cut at them. Other columns are not read.
    """
    model = Markov(n_samples, seed)

    def row(text: str | None) -> tuple:
        base, more = scan(text, model)
        kinds = [k for _, k, _ in base]
        return kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(docs, [F.col(id_col).alias("doc_id")], text_col, schema, lambda: row)
