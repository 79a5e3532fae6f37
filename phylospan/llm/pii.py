"""Personal data: fixed base patterns, and spans that a character-level tagger adds to them.

The tagger (:mod:`phylospan.llm.tagger`) is trained on windows of the corpus with the spans that the base
patterns label, also in other spellings, and with made-up items in forms that they do not cover.  It knows one
kind more than the patterns: ``secret``, a key or token that stands with its name.  A text's windows overlap by
half; each is decoded by itself, and the spans that any of them finds compete by score in one global choice of
spans that do not overlap.  A span needs a digit, ``@``, ``[at]`` or ``(at)``, so windows lie around these: every
text that :func:`plausible` can accept is inside some window, with :data:`CONTEXT` characters on either side.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phylospan.llm.common import quoted
from phylospan.llm.tagger import Tagger, fit
from phylospan.shipping import ship

#: Kinds of the base patterns, and all kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
WINDOW, STRIDE = 80, 40
#: Characters around a possible span that windows cover, and those on either side of it that some window has.
AROUND, CONTEXT = 40, 16
#: A window's spans so near to its edge are left to another window.
EDGE = 8
#: Characters of the longest plausible span but for addresses (15 digits, two separators between any two, ``+(`` before).
NUMBER = 45
#: Characters of a local part, and of a domain with its dots written out, at most (RFC 5321: 64 and 255).
LOCAL, DOMAIN = 64, 1100
#: Documents that training windows are taken from, and windows of each source.
SAMPLE, MADE, FOUND = 300, 3600, 600
HIDDEN, EPOCHS, SEED = 20, 8, 5
#: Windows decoded at once.
BATCH = 512

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset(string.ascii_letters + string.digits + "._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")
_at = r"(?:@| ?[\[(](?i:at)[\])] ?)"
_dot = r"(?:\.| ?[\[(](?i:dot)[\])] ?)"
_marker = re.compile(_at)
_labels_on = re.compile(rf"[A-Za-z0-9-]++(?:{_dot}[A-Za-z0-9-]++)*+")
_number_like = re.compile(r"[0-9][\x20()/.+0-9-]*+")
#: Characters of a secret, and how many of them it has at least.
_secret_like = re.compile(r"[A-Za-z0-9_+/=-]{16,}+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_digit.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order: the leftmost non-overlapping matches of each kind's pattern that pass its test.

    Time is linear in the text: an address is looked for around each ``@``, and a run of digits is only
    tried from its start.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _digit.search(text):
        found += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in _card.finditer(text) if len(m[0]) >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# --- symbols and training windows --------------------------------------------------------------------

_symbols = {c: k for k, c in enumerate(string.ascii_lowercase + string.punctuation + " \n", 1)}
_DIGIT, _LETTER, _OTHER = len(_symbols) + 1, len(_symbols) + 2, len(_symbols) + 3
SYMBOLS = len(_symbols) + 4
_known = {**_symbols, **{c.upper(): _symbols[c] for c in string.ascii_lowercase}, **dict.fromkeys(string.digits, _DIGIT)}
LABELS = 1 + 2 * len(KINDS)


def _numbers(text: str) -> list[int]:
    """Symbol numbers: letters without case, all digits alike, punctuation by itself; 0 is outside the text."""
    get = _known.get
    return [get(c) or (_LETTER if c.isalpha() else _OTHER) for c in text]


def _labels(n: int, spans) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for start, kind, end in spans:
        y[start:end] = 2 + 2 * kind
        y[start] = 1 + 2 * kind
    return y


def _number(rng, n):
    return "".join(rng.choice(string.digits) for _ in range(n))


def _word(rng, lo=2, hi=9):
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(lo, hi)))


def made_item(rng: random.Random) -> tuple[int, str]:
    """A made-up item and its kind (-1: no personal data), in forms in and beyond the base patterns."""
    form = rng.randrange(18)
    if form < 3:
        label = lambda: rng.choice([_word(rng), _word(rng), _word(rng, 8, 14), f"{_word(rng)}-{_word(rng)}"]) + rng.choice(["", "", _number(rng, 1)])
        domain = ".".join([*(label() for _ in range(rng.choice([1, 1, 2]))), rng.choice(["com", "net", "org", "de", "fr"])])
        user = _word(rng) + (rng.choice(["", ".", "_", "-"]) + rng.choice([_number(rng, 2), _word(rng)]) if rng.random() < 0.7 else "")
        at, dot = [("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")][form]
        return 0, user + at + domain.replace(".", dot)
    if form < 5:
        return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if form < 7:
        n = rng.choice("3456") + _number(rng, 14)
        n += next(d for d in string.digits if luhn(n + d))
        sep = rng.choice(["", " ", "-"])
        return 2, sep.join(n[k : k + 4] for k in range(0, 16, 4))
    if form < 10:
        area, a, b = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return 3, [f"+{rng.randint(1, 99)} ({area}) {a}-{b}", f"({area}) {a}-{b}{_number(rng, 1)}", f"0{area[:2]}-{a}-{b}"][form - 7]
    if form == 10:
        return -1, f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    if form == 11:
        return -1, f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}"
    if form == 12:
        return -1, f"v{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}"
    if form == 13:
        return -1, rng.choice(["#", "no. ", "$", ""]) + _number(rng, rng.randint(1, 11))
    if form == 14:
        return -1, "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randint(16, 40)))
    if form > 15:
        n = rng.choice([16, 20, 24, 32, 40, 40, 48, 64])
        return 4, "".join(rng.choices(rng.choice([_HEX, _HEX, _KEY]), k=n))
    return -1, f"{_number(rng, rng.randint(1, 6))}.{_number(rng, 2)}"


_HEX, _KEY = "0123456789abcdef", string.ascii_letters + string.digits + "_-"


def _named(rng: random.Random) -> tuple[str, str]:
    """What stands before and behind a made-up secret: its name, a sign, and quotes or none."""
    name = rng.choice(["token", "key", "api_key", "apikey", "secret", "password", "passwd", "auth", "access_token", "API_KEY", "Token"])
    quote = rng.choice(['"', '"', "'", ""])
    return name + rng.choice([" = ", " = ", "=", ": ", ":"]) + quote, quote


def _respelled(rng: random.Random, kind: int, item: str) -> str:
    """A real span in a spelling that the base patterns do not know."""
    if kind == 0:
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", ".")])
        user, _, domain = item.partition("@")
        return user + at + domain.replace(".", dot)
    if kind == 3:
        digits = _digits(item)
        if len(digits) < 9:
            return item
        a, b = len(digits) - 7, len(digits) - 4
        return rng.choice([f"({digits[:a]}) {digits[a:b]}-{digits[b:]}", f"{digits[:a]}-{digits[a:b]}-{digits[b:]}", f"{digits[:a]} {digits[a:b]} {digits[b:]}"])
    return item


def training_windows(texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: made-up items set into pieces of the texts, and the texts' own base spans."""
    rng = random.Random(seed)
    plain = [t for t in texts if len(t) > WINDOW] or [" ".join(_word(rng) for _ in range(60)) for _ in range(20)]
    windows = []
    for _ in range(MADE):
        t = rng.choice(plain)
        k = rng.randrange(len(t) - WINDOW)
        piece = t[k : k + WINDOW]
        text, spans = "", []
        at = 0
        for cut in sorted(rng.sample(range(5, WINDOW - 5), rng.choice([1, 1, 1, 2]))):
            kind, item = made_item(rng)
            before, behind = _named(rng) if kind == 4 else ("", "")
            text += piece[at:cut] + rng.choice([" ", " ", ": ", "\n"]) + before
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(item)))
            text += item + behind + rng.choice([" ", " ", ". ", ", ", "\n"])
            at = cut
        text += piece[at:]
        spans += [b for b in base_spans(text) if not any(b[0] < e and s < b[2] for s, _, e in spans)]
        off = rng.randint(0, max(0, len(text) - WINDOW))
        windows.append((text, spans, off))
    own = [(t, spans) for t in texts if (spans := base_spans(t))]
    for _ in range(FOUND if own else 0):
        t, spans = rng.choice(own)
        s, kind, e = rng.choice(spans)
        if rng.random() < 0.5:
            item = _respelled(rng, kind, t[s:e])
            t = t[max(0, s - WINDOW) : s] + item + t[e : e + WINDOW]
            s = min(s, WINDOW)
            e = s + len(item)
            spans = [*(b for b in base_spans(t) if b[2] <= s or b[0] >= e), (s, kind, e)]
        windows.append((t, spans, max(0, rng.randint(e - WINDOW, s) if e - s < WINDOW else s)))
    x, y = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int8)
    for k, (text, spans, off) in enumerate(windows):
        n = _numbers(text[off : off + WINDOW])
        x[k, : len(n)] = n
        inside = [(max(s - off, 0), q, min(e - off, WINDOW)) for s, q, e in spans if e > off and s < off + WINDOW]
        y[k] = _labels(WINDOW, inside)
    return x, y


def sample_texts(docs: DataFrame, text_col: str = "text", n: int = SAMPLE) -> list[str]:
    """At most ``n`` different texts, those of the least hashes, so the same ones for the same rows.

    The least distinct hashes are chosen first, so copies do not count, and only their texts are gathered.
    """
    rows = docs.select(quoted(text_col).cast("string").alias("text")).where("text is not null")
    hashed = rows.select("text", F.xxhash64("text").alias("h"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(n).collect()]
    mine = hashed.where(F.col("h") <= (least[-1] if least else 0))
    picked = mine.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(n).collect()
    return sorted(r.text for r in picked)


def _allowed() -> np.ndarray:
    """A span's inner label only follows a label of the same kind."""
    ok = np.ones((LABELS, LABELS), bool)
    for kind in range(len(KINDS)):
        ok[:, 2 + 2 * kind] = False
        ok[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return ok


def train(texts: list[str], seed: int = SEED) -> Tagger:
    return fit(SYMBOLS, LABELS, *training_windows(texts, seed), allowed=_allowed(), hidden=HIDDEN, epochs=EPOCHS, seed=seed)


# --- decoding ----------------------------------------------------------------------------------------

_mail_like = re.compile(rf"[A-Za-z0-9._%+-]+{_at}[A-Za-z0-9-]+(?:{_dot}[A-Za-z0-9-]+)+\Z")
_phone_like = re.compile(r"\+?\(?[0-9](?:[\x20()/.-]{0,2}[0-9])+\Z")


def plausible(kind: int, text: str, before: str, after: str) -> bool:
    """Whether a tagged span is a whole item of its kind: its form, digits and neighbours are right."""
    if kind == 0:
        return _mail_like.match(text) is not None
    if before.isalnum() or after.isalnum():
        return False
    digits = _digits(text)
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text) is not None and all(int(p) <= 255 for p in text.split(".")) and before != "." and after != "."
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[\x20/.-]?[0-9])+", text) is not None
    if kind == 4:
        return _secret_like.fullmatch(text) is not None and bool(digits) and len(set(text)) >= 8
    groups = len(re.findall("[0-9]+", text))
    return 9 <= len(digits) <= 15 and groups >= 2 and _phone_like.match(text) is not None


def possible_spans(text: str) -> list[tuple[int, int, bool]]:
    """In order ``(start, end, whole)``: each plausible span lies in one of these, which is a possible address or secret (``whole``) or a run of digits and separators."""
    found = []
    for m in _marker.finditer(text):
        start, least = m.start(), max(0, m.start() - LOCAL)
        while start > least and text[start - 1] in _local:
            start -= 1
        domain = _labels_on.match(text, m.end(), m.end() + DOMAIN) if start < m.start() else None
        if domain:
            found.append((start, domain.end(), True))
    for m in _secret_like.finditer(text):
        if _digit.search(m[0]) and len(set(m[0])) >= 8:
            found.append((m.start(), m.end(), True))
    for m in _number_like.finditer(text):
        start = m.start()
        start -= text.startswith("(", max(0, start - 1), start)
        start -= text.startswith("+", max(0, start - 1), start)
        found.append((start, m.start() + len(m[0].rstrip(" ()/.+-")), False))
    return sorted(found)


def window_starts(text: str) -> list[tuple[int, int]]:
    """``(start, width)`` of the windows: overlapping tiles around the possible spans, and what these may not hold whole."""
    possible = possible_spans(text)
    out: list[tuple[int, int]] = []
    lo = hi = -1
    for s, e, _ in possible:
        if hi >= 0 and s - AROUND <= hi:
            hi = max(hi, min(len(text), e + AROUND))
            continue
        if hi >= 0:
            out += [(k, WINDOW) for k in _tiles(lo, hi)]
        lo, hi = max(0, s - AROUND), min(len(text), e + AROUND)
    if hi >= 0:
        out += [(k, WINDOW) for k in _tiles(lo, hi)]
    at = end = -1
    for s, e, whole in possible:
        first, last = max(0, s - CONTEXT), min(len(text), e + CONTEXT)
        if at >= 0 and at <= first and last <= end:
            continue
        if whole or last - first <= WINDOW:
            at, end = first, first + max(WINDOW, -(-(last - first) // STRIDE) * STRIDE)
            out.append((at, end - at))
        else:  # a number is at most so long, so one of these has it with its neighbours
            width = NUMBER + 2 * CONTEXT + STRIDE
            out += [(k, width) for k in range(first, max(first + 1, last - width + STRIDE), STRIDE)]
    return list(dict.fromkeys(out))


def _tiles(lo: int, hi: int) -> list[int]:
    return [lo, *range(lo + STRIDE, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)] if hi - lo > WINDOW else [lo]


def reconciled(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of ``(score, start, kind, end)`` the non-overlapping spans of the highest total score, as ``(start, kind, end)``."""
    spans = sorted(set(spans), key=lambda s: (s[3], s[1], s[2], -s[0]))
    ends = [s[3] for s in spans]
    best: list[tuple[float, int | None, bool]] = [(0.0, None, False)]
    for k, (score, start, _, _) in enumerate(spans):
        j = bisect_right(ends, start, 0, k)
        take = best[j][0] + score
        best.append((take, j, True) if take > best[k][0] else (best[k][0], k, False))
    out, k = [], len(spans)
    while k:
        _, j, taken = best[k]
        if taken:
            out.append(spans[k - 1][1:])
        k = j
    return sorted(out)


class Finder:
    """Finds the spans of texts: base ones, and what the tagger adds."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """``(base spans, added spans)`` of each text; the windows of all texts are decoded together."""
        base = [base_spans(t) for t in texts]
        proposed: list[list] = [[] for _ in texts]
        by_width: dict[int, list] = {}
        for d, t in enumerate(texts):
            for s, width in window_starts(t):
                by_width.setdefault(width, []).append((d, s))
        for width, todo in by_width.items():
            size = max(1, BATCH * WINDOW // width)
            for lo in range(0, len(todo), size):
                part = todo[lo : lo + size]
                x = np.zeros((len(part), width), np.int64)
                for k, (d, s) in enumerate(part):
                    n = _numbers(texts[d][s : s + width])
                    x[k, : len(n)] = n
                e = self.tagger.emissions(x)
                best = self.tagger.decode(e)
                for k in np.flatnonzero(best.any(axis=1)):
                    d, s = part[k]
                    proposed[d] += self._spans(best[k], e[:, k], s, texts[d])
        return [(b, self._added(t, b, p)) for t, b, p in zip(texts, base, proposed)]

    def _spans(self, labels, scores, offset, text):
        at, out, width = 0, [], len(labels)
        while at < width:
            if labels[at] == 0 or labels[at] % 2 == 0:
                at += 1
                continue
            kind, start = (labels[at] - 1) // 2, at
            at += 1
            while at < width and labels[at] == 2 + 2 * kind:
                at += 1
            cut = (start < EDGE and offset > 0) or (at > width - EDGE and offset + width < len(text))
            if not cut and offset + at <= len(text):  # what is at the window's edge is whole and further from it in another one
                gain = float(scores[np.arange(start, at), labels[start:at]].sum() - scores[start:at, 0].sum())
                out.append((round(gain, 3), offset + start, int(kind), offset + at))
        return out

    def _added(self, text, base, proposed):
        """Proposed spans that touch no base span, are plausible, and win where they overlap."""
        good = []
        for gain, start, kind, end in proposed:
            while start < end and text[start].isspace():
                start += 1
            while end > start and text[end - 1] in " \n\t.,;:":
                end -= 1
            if gain > 0 and not any(s < end and start < e for s, _, e in base) and plausible(kind, text[start:end], text[start - 1 : start], text[end : end + 1]):
                good.append((gain, start, kind, end))
        return reconciled(good)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


# --- operators ---------------------------------------------------------------------------------------


class _Slices:
    """Runs a function over slices of Arrow batches, with the trained tagger's finder."""

    def __init__(self, packed, make, schema, rows=256):
        self.packed, self.make, self.schema, self.rows = packed, make, schema, rows

    def __call__(self, batches):
        finder = Finder(Tagger.of(*self.packed.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, self.rows):
                part = batch.slice(lo, self.rows)
                yield pa.RecordBatch.from_arrays(self.make(finder, part), schema=self.schema)


def _reported(finder, part):
    texts = [t or "" for t in part.column(1).to_pylist()]
    rows = []
    for base, added in finder.find(texts):
        n = [sum(k == q for _, k, _ in base) for q in range(len(BASE))]
        rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed([*base, *added]), len(added)))
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
    return [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]


def find_personal_data(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` per row of ``docs``.

    The four counts and the digest are of the base spans; ``spans`` lists these and the ``n_added`` spans of
    the tagger, which may also be of the kind ``secret``.  Null and empty texts have none; a null id stays null; repeated rows repeat; other columns are
    ignored; an empty table gives an empty one.  A very long text is read whole, its tagger's windows in batches.  No shuffle.
    """
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((tagger.hidden, tagger.p))  # some 50 KB
    schema = T._parse_datatype_string("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_Slices(packed, _reported, to_arrow_schema(schema)), schema)


def mask_personal_data(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts masked; all other columns, whatever their names, as they are.

    Null texts stay null, empty ones empty, repeated rows repeat; an empty table gives an empty one.  No shuffle.
    """
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((tagger.hidden, tagger.p))
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if k == at else f.dataType, True) for k, f in enumerate(docs.schema.fields)])

    def make(finder, part):
        texts = part.column(at).to_pylist()
        found = finder.find([t or "" for t in texts])
        new = [None if t is None else masked(t, [*b, *a]) for t, (b, a) in zip(texts, found)]
        return [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(part.columns)]

    return docs.mapInArrow(_Slices(packed, make, to_arrow_schema(schema)), schema)
