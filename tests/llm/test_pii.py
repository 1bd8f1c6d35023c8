"""Personal data: base patterns against plain regular expressions, disguises, offsets."""

import hashlib
import random
import re
import time

import pytest

from touchline.llm import pii


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(digits(m.group())) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(9)
    for alphabet in ("ab.@-+%_ 1A", "0123456789. -+()", "12.5 é@a.-", "+12 ()-.4"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert pii.base_spans(t) == brute(t), t


@pytest.mark.parametrize("kind, text, hidden", [
    ("email", "mail bob [at] mail5 [dot] example [dot] com now", "bob [at] mail5 [dot] example [dot] com"),
    ("email", "to jane.roe at example dot com today", "jane.roe at example dot com"),
    ("email", "user(at)site(dot)org", "user(at)site(dot)org"),
    ("email", "Bоb＠example．com", "Bоb＠example．com"),
    ("email", "x a​b@ex​ample.com y", "a​b@ex​ample.com"),
    ("ip", "host 12 [dot] 71 [dot] 76 [dot] 174 up", "12 [dot] 71 [dot] 76 [dot] 174"),
    ("card", "no ４２８４８９６６０９０４５８３６ ok", "４２８４８９６６０９０４５８３６"),
    ("phone", "call plus one four one four five five five seven one three four now",
     "plus one four one four five five five seven one three four"),
    ("email", "write to ann.lee @ example.com please", "ann.lee @ example.com"),
    ("ip", "at 1O.l2.33.144 now", "1O.l2.33.144"),
    ("card", "no 4284 896O 9O45 8368 l ok", None),
    ("card", "no 4284 8966 O9O4 5836 ok", "4284 8966 O9O4 5836"),
    ("phone", "call +1 four one four 555 seven one three four!", "+1 four one four 555 seven one three four"),
])
def test_disguises_map_back_to_the_source(kind, text, hidden):
    base, full = pii.find(text)
    more = [(k, text[a:b]) for k, a, b in full if (k, a, b) not in base]
    assert more == ([(kind, hidden)] if hidden else [])


@pytest.mark.parametrize("text", [
    "", "we met at noon dot the end", "one two three go", "at the dot", "look at example.com there",
    "El niño comió dos tacos y tres uvas", "Größe über alles, fünf vor zwölf", "un deux trois soleil",
    "the · dot and – dashes – are prose", "привет мир", "αβγ δεζ", "five six seven eight dancers",
    "room 10l and 2O4", "meet @ noon . ok", "ISO 9OOl:2015", "x @ y"])
def test_clean_texts_have_no_spans(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("text, hidden", [
    ("write to ann.lee at example.com please", "ann.lee at example.com"),
    ("write to ann.lee@ example.com please", "ann.lee@ example.com"),
    ("write to ann.lee @example.com please", "ann.lee @example.com"),
    ("reach me at ann_lee at example.co.uk.", "ann_lee at example.co.uk"),
    ("reach me at ann7@\nexample.org", "ann7@\nexample.org"),
    ("look at example.com there", None),
    ("opened 2019 at example.com there", None),
    ("ann.lee at example.nowhere", None),
    ("mail us @ noon.ok", None)])
def test_a_disguise_does_not_depend_on_its_neighbours(text, hidden):
    """Alone, and next to a sign of another disguise."""
    want = [hidden] if hidden else []
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == want
    for sign in ("the [dot] sign", "a \u200b b", "one two"):
        both = f"{text} | {sign}"
        assert [both[a:b] for _, a, b in pii.find(both)[1]] == want, both


def test_documents(spark, make_docs, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(30, "é a@b.co 1.2.3.4 +1 (414) 555-7134"), (30, "x"), (None, "a@b.co"),
                                                      (31, "w " * 50_000 + "z@y.org " + "w " * 50_000)]
    got = pii.digest(pii.personal_data(make_docs(rows))).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), pii.written(brute(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.spans) for r in got) == want
    for r in got:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()  # nothing is hidden here
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(r.spans.count(k + ":") for k in pii.KINDS)
    assert pii.digest(pii.personal_data(make_docs([]))).count() == 0


@pytest.mark.parametrize("name, text", [
    ("digits", "0" * 1_000_000),
    ("digits and letters", "0O" * 500_000),
    ("dotted", "1." * 500_000),
    ("large octet", "0" * 5000 + ".1.2.3 " + "9" * 5000 + ".1.2.3"),
    ("name without end", "a." * 500_000 + " @ b"),
    ("name and host without end", "a." * 250_000 + " @ " + "b." * 250_000 + "com"),
    ("signs", "x[at]" * 200_000),
    ("addresses", "ann [at] site [dot] org " * 10_000),
    ("bare words", "a at b dot at dot " * 50_000),
    ("blanks", "a [at] " + " " * 1_000_000 + " b [dot] c"),
    ("spelled", "one 2 " * 150_000),
    ("at signs", "a@" * 500_000),
    ("brackets", "[" * 500_000 + "(at)" * 10),
    ("odd letters", "а​" * 300_000),
])
def test_time_follows_the_length(name, text):
    """Texts of about 1 MB that patterns can dwell on: a few seconds each, and
    base spans as the plain patterns where those end."""
    start = time.process_time()
    base, _ = pii.find(text)
    assert time.process_time() - start < (2 if text.isascii() and name != "addresses" else 6)
    short = text[:300] + text[-300:]
    assert pii.base_spans(short) == brute(short)
    if name in ("digits", "large octet"):
        assert base == ([("ip", 0, 5006)] if name == "large octet" else [])


def test_pieces_of_a_long_stretch_meet():
    """Disguised addresses across the borders of the pieces are found whole."""
    text = "w[at]h[dot]org," * 6_000
    got = pii.find(text)[1]
    assert [text[a:b] for _, a, b in got] == ["w[at]h[dot]org"] * 6_000
