"""Personal data with offset-preserving deobfuscation (operator 10).

Base spans come from the text as it is.  For the method's own spans, stretches
of text that show a disguise are normalised by small transducers: look-alike
letters and digits (full-width, mathematical, Cyrillic, Greek) become ASCII,
invisible characters vanish, spelled digits become digits, and "at"/"dot"
disguises become ``@`` and ``.``.  Each output character remembers the stretch
of source characters it came from, so a span found in the normalised text maps
back to the source.  Offsets are code points, ends are exclusive.

Every step takes time in proportion to the text, whatever it holds: digit runs
are found once and grouped, disguised addresses are looked for around each
``at`` only, and a disguised address has bounded pieces (a name of at most
``_PIECES`` pieces of 64 characters, a host of at most ``_LABELS`` labels of
63), so that a stretch of dots or letters without end is passed over at once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed by the task
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


_NO_DIGITS = re.compile("[^0-9]+")


def _digits(s: str) -> str:
    return _NO_DIGITS.sub("", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # every match holds an @ directly after its run of local characters, so look from there
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield "email", start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    # a match takes whole numbers from the left, so the numbers of a dotted run go four by four
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        lo = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            hi = lo + sum(map(len, four)) + 3
            if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in four):
                yield "ip", lo, hi
            lo = hi + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns, in order of start, then kind."""
    out = [*_emails(text), *_ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


# ---- the method: transducers
#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ℓ": "l", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "∙": ".", "·": ".",
    " ": " ",
}
_GONE = frozenset("­​‌‍⁠﻿")
#: Spelled digits (English, German, French, Spanish).
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_PLUS = {"plus": "+"}
#: Endings that make a bare "name at host dot ending" an address (fixed values).
_ENDINGS = frozenset("com org net edu gov mil int info biz io co app dev ai eu uk us ca au de at ch fr be es mx ar pt br "
                     "it nl se no dk fi pl cz ru cn jp kr in".split())
_DIGIT_WORD = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_AT = r"(?:[\[({<]\s*(?:at|@|arroba|chez)\s*[\])}>]|\s+(?:at|arroba)\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+)"
_PIECES, _LABELS = 16, 32
_ATOM = r"[A-Za-z0-9_%+-]{1,64}+(?![A-Za-z0-9_%+-])"
_LABEL = r"[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9-])"
#: The sign of a disguised address, what follows it, and (read backwards) what leads to it.
_AT_SIGN = re.compile(rf"\s*(?:@|{_AT})\s*", re.I)
_HOST = re.compile(rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL}){{1,{_LABELS}}}", re.I)
_DOT_BACK = (r"(?:\s*[\])}>]\s*(?:tod|\.|tknup|tniop|otnup)\s*[\[({<]\s*|\s+(?:tod|tknup|otnup)\s+)")
_NAME_BACK = re.compile(rf"{_ATOM}(?:(?:\.|{_DOT_BACK}){_ATOM}){{0,{_PIECES - 1}}}", re.I)
_HIDDEN_IP = re.compile(rf"[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}", re.I)
#: Spelled digits and numbers one after another; four in a row, the first three spelled, make a run of them.
_NUMBERS = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD}|[0-9]++)(?!\w)(?:[\s.()-]++(?:{_DIGIT_WORD}|[0-9]++)(?!\w))*+", re.I)
_FOUR = re.compile(rf"(?<!\w)(?:(?:{_DIGIT_WORD})[\s.()-]++){{3}}(?:{_DIGIT_WORD}|[0-9]++)(?!\w)", re.I)
_LEAD = re.compile(r"(?:(?<!\w)\+|(?<!\w)plus\s{1,8})\Z", re.I)
_TOKEN = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD}|plus)(?!\w)", re.I)
#: Cheap signs that a text may hide something.
_ODD = re.compile("[­​-‍⁠﻿Ͱ-ϿЀ-ԯ！-～\U0001d400-\U0001d7ff"
                  "⁰-ₜ²³¹①-⓿ıℓ․。｡∙]")
_SIGN = re.compile(rf"[\[({{<]\s*(?:at|@|arroba|chez|dot|\.|punkt|point|punto)\s*[\])}}>]|\s(?:dot|punkt|punto|arroba)\s"
                   r"|\s@|@\s|\sat\s+[a-z0-9-]+\.[a-z0-9-]", re.I)
#: Letters that stand for digits among digits, and numbers that hold some.
_AS_DIGIT = str.maketrans("OoQlI|", "000111")
_MIX = re.compile(r"[0-9][OoQlI|]|[OoQlI|][0-9]")
_MIXED = re.compile(r"(?<!\w)\+?[0-9OoQlI|]+(?:[ .()-]{1,2}[0-9OoQlI|]+)*(?!\w)")
_COUNT = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD})[\s.()-]+(?:{_DIGIT_WORD})(?!\w)", re.I)
_WINDOW = 120  # code points around a sign that are normalised
_REACH = 4096  # code points that a stretch is widened by at most, more than an address holds
_PIECE, _OVERLAP = 1 << 15, 2 * _REACH  # a long stretch is normalised in pieces
_WHITE = re.compile(r"\s{9,}")


class Mapped:
    """Normalised text with the source stretch of each of its characters."""

    def __init__(self, text: str, start: list[int], end: list[int]):
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str, at: int = 0) -> Mapped:
        return cls(text, list(range(at, at + len(text))), list(range(at + 1, at + len(text) + 1)))

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        return self.start[lo], self.end[hi - 1]

    def rewrite(self, pattern: re.Pattern, by) -> Mapped:
        """Each match becomes ``by(match)``.  Its characters map one by one if it is
        as long as the match, else all to the whole match."""
        text, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None or m.start() == m.end():
                continue
            text.append(self.text[last:m.start()])
            start += self.start[last:m.start()]
            end += self.end[last:m.start()]
            text.append(new)
            if len(new) == m.end() - m.start():
                start += self.start[m.start():m.end()]
                end += self.end[m.start():m.end()]
            else:
                a, b = self.source(m.start(), m.end())
                start += [a] * len(new)
                end += [b] * len(new)
            last = m.end()
        text.append(self.text[last:])
        return Mapped("".join(text), start + self.start[last:], end + self.end[last:])


    def at_places(self, spans: list[tuple[int, int]], change) -> Mapped:
        """Each of the disjoint ``spans``, in order, becomes what ``change`` makes of it."""
        text, start, end, last = [], [], [], 0
        for lo, hi in [*spans, (len(self.text), len(self.text))]:
            part = change(Mapped(self.text[lo:hi], self.start[lo:hi], self.end[lo:hi]))
            text += [self.text[last:lo], part.text]
            start += [*self.start[last:lo], *part.start]
            end += [*self.end[last:lo], *part.end]
            last = hi
        return Mapped("".join(text), start, end)


def fold(m: Mapped) -> Mapped:
    """Look-alike characters become ASCII, invisible ones vanish; of a long
    run of white space eight blanks stay, which no pattern tells from more."""
    m = m.rewrite(_WHITE, lambda _: " " * 8)
    if m.text.isascii():
        return m
    text, start, end = [], [], []
    for c, a, b in zip(m.text, m.start, m.end, strict=True):
        if c in _GONE:
            continue
        new = _LOOKS.get(c)
        if new is None:
            new = c
            if c > "¯" and not c.isalpha() or c > "῿":
                wide = unicodedata.normalize("NFKC", c)
                if wide.isascii() and wide:
                    new = wide
        for x in new:
            text.append(x)
            start.append(a)
            end.append(b)
    return Mapped("".join(text), start, end)


def _address(name: str, at: str, host: str) -> bool:
    """Whether a disguised address is taken as one.  It depends on its text alone."""
    whole = name + at + host
    if not re.search(r"\s", whole) or re.search(r"[\[({<]", whole):
        return True
    if re.split(r"[\s.]+", host)[-1].lower() not in _ENDINGS:
        return False  # "at noon dot the end" is no address
    if at.strip().lower() != "at" or re.search(r"\s", host):
        return True
    # "look at example.com", "2019 at example.com" are prose; "ann.lee at example.com" is not
    return bool(re.search(r"[\s._0-9]", name) and re.search("[A-Za-z]", name))


def _addresses(text: str) -> list[tuple[int, int]]:
    """Disguised addresses: around each sign, a host after it and a name before it."""
    out, last, back, n = [], 0, text[::-1], len(text)
    for at in _AT_SIGN.finditer(text):
        if at.start() < last:
            continue
        host = _HOST.match(text, at.end())
        name = _NAME_BACK.match(back, n - at.start(), n - last) if host else None
        if name and _address(name.group()[::-1], at.group(), host.group()):
            last = host.end()
            out.append((n - name.end(), last))
    return out


_DOTS = re.compile(_DOT, re.I)


def undo_signs(m: Mapped) -> Mapped:
    """Within disguised addresses, at and dot become ``@`` and ``.``."""
    def plain(part: Mapped) -> Mapped:
        return part.rewrite(_DOTS, lambda _: ".").rewrite(_AT_SIGN, lambda _: "@")
    for found in (_addresses, lambda t: [x.span() for x in _HIDDEN_IP.finditer(t)]):
        m = m.at_places(found(m.text), plain)
    return m


def undo_letters(m: Mapped) -> Mapped:
    """In numbers of at least six digits, letters that look like digits become digits."""
    return m.rewrite(_MIXED, lambda t: t.group().translate(_AS_DIGIT) if len(_digits(t.group())) >= 6 else None) \
        if _MIX.search(m.text) else m


_GAP = re.compile(r"(?<=[0-9+])\s+(?=[0-9])")


def undo_digits(m: Mapped) -> Mapped:
    """Within runs of spelled digits, each word becomes its digit; the blanks between go."""
    spans = []
    for hit in _NUMBERS.finditer(m.text):
        if _FOUR.search(hit.group()):
            lead = _LEAD.search(m.text, max(0, hit.start() - 16), hit.start())
            spans.append((lead.start() if lead else hit.start(), hit.end()))
    return m.at_places(spans, lambda part: part.rewrite(
        _TOKEN, lambda t: _SPELLED.get(t.group().lower(), _PLUS.get(t.group().lower()))).rewrite(_GAP, lambda _: ""))


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Further spans that show only after normalisation; none overlaps a base span of its kind."""
    signs = [x.start() for p in (() if text.isascii() else (_ODD,)) for x in p.finditer(text)]
    signs += [x.start() for x in _SIGN.finditer(text)] + [x.start() for x in _COUNT.finditer(text)]
    signs += [x.start() for x in _MIX.finditer(text)]
    if not signs:
        return []
    stretches: list[list[int]] = []
    for p in sorted(signs):  # widened to white space, so that no identifier is cut
        done = stretches[-1][1] if stretches else 0
        lo, hi = max(0, p - _WINDOW), max(done, min(len(text), p + _WINDOW))
        least, most = max(done, lo - _REACH), min(len(text), hi + _REACH)
        while lo > least and not text[lo - 1].isspace():
            lo -= 1
        while hi < most and not text[hi].isspace():
            hi += 1
        if stretches and lo <= done:
            stretches[-1][1] = hi
        else:
            stretches.append([lo, hi])
    taken = {k: [s for s in base if s[0] == k] for k in KINDS}
    starts = {k: [s[1] for s in taken[k]] for k in KINDS}

    def free(kind: str, lo: int, hi: int) -> bool:
        i = bisect_right(starts[kind], lo)  # base spans of a kind do not overlap
        return not (i and taken[kind][i - 1][2] > lo) and not (i < len(starts[kind]) and starts[kind][i] < hi)

    out: set[Span] = set()
    for first, last in stretches:
        for at in range(first, last, _PIECE):
            lo, hi = max(first, at - _OVERLAP), min(last, at + _PIECE + _OVERLAP)
            m = undo_letters(undo_digits(undo_signs(fold(Mapped.of(text[lo:hi], lo)))))
            if m.text == text[lo:hi]:
                continue
            for kind, a, b in base_spans(m.text):
                s, e = m.source(a, b)
                whole = (s > lo or lo in (0, first)) and (e < hi or hi in (len(text), last))
                if at <= s < at + _PIECE and whole and free(kind, s, e):
                    out.add((kind, s, e))
    return sorted(out, key=_order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text."""
    text = text or ""
    base = base_spans(text)
    more = hidden_spans(text, base)
    return base, sorted({*base, *more}, key=_order)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, spans`` (all) and ``base`` (base
    spans), each an array of ``(kind, start, end, text)`` in order of start.

    Whole texts are searched; a null text has no spans; repeated rows each get
    their own; a null doc_id stays null.  Extra columns are ignored; an empty
    table gives an empty result."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = [], []
            for t in batch.column(1).to_pylist():
                b, a = find(t)
                for spans, into in ((b, base), (a, full)):
                    into.append([{"kind": k, "start": s, "end": e, "text": t[s:e]} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array(full, pa.list_(span))],
                names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint,text:string>>"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    added = F.size("spans") - F.size("base")
    return found.select("doc_id", *count, F.sha2(line("base").cast("binary"), 256).alias("base_sha256"),
                        line("spans").alias("spans"), added.cast("long").alias("n_added"))
