"""Personal data: exact base patterns, and spans added by a character-level BiLSTM-CRF.

The model learns from labelled spans of five kinds: those of the base patterns in spellings that the patterns miss, and
secrets (keys and tokens). Every span of these kinds holds a digit or an at-sign (also written "(at)" or "[at]"): `fits`
refuses any other. So windows are laid over the words around those, whole words and at least `WORDS_AROUND` of them on both sides,
and what lies elsewhere could add nothing. The windows overlap; the emissions of a character are averaged over its windows by
how central it stands in them, and one Viterbi pass decodes them. No span crosses a character that no kind allows (a line
end, a comma, a letter with an accent), so the pass is cut there without a change of its result.

A decoded span says where and of which kind; it is grown to whole words, and the parts of it that pass their kind's check are
taken from the left, the longest first, so that numbers which stand side by side are told apart. An added span touches no base span and no other.

Defined results: a null or empty text has no spans; positions are code points; repeated rows are judged each; an
empty table gives an empty result; very long texts and words are worked on whole; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from firmlens.llm import bilstmcrf
from firmlens.llm.tokens import _byte_groups

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
T = 64
WORDS_AROUND = 7

#: The base patterns. They are matched so that no run of characters is read again and again.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@]|[\[(]at[\])]")
#: Characters that a span of some kind may hold.
_allowed = np.zeros(128, bool)
_allowed[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 @._%+-()[]/="]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        # the local part: the run of its characters before the sign, not before the last match
        lo = at
        while lo > end and _local.match(text, lo - 1):
            lo -= 1
        m = _domain.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end(), 0))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    for m in _ip.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in _card.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    for m in _phone.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


_email_like = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")
_ip_like = re.compile(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\))[0-9]{1,3}){3}")
_card_like = re.compile(r"[0-9](?:[ ./-]{0,2}[0-9])+")
_phone_like = re.compile(r"\+? ?\(?[0-9](?:[ ()./-]{0,2}[0-9])+")
_secret_like = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")


def fits(kind: str, s: str) -> bool:
    """Whether an added span can be of its kind."""
    d = _digits(s)
    if kind == "email":
        return bool(_email_like.fullmatch(s))
    if kind == "ip":
        return bool(_ip_like.fullmatch(s)) and all(int(x) <= 255 for x in re.findall("[0-9]+", s))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and bool(_card_like.fullmatch(s))
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(_phone_like.fullmatch(s)) and len(re.findall(r"[ ()./-]+", s)) >= 2
    return len(d) >= 3 and bool(_secret_like.fullmatch(s)) and any(c.isalpha() for c in s)



def grow(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A decoded span grown to whole words; for cards, with the numbers beside it."""
    within = (lambda c: c in "0123456789 ./-") if kind == "card" else (lambda c: c != " " and c < "\x80" and _allowed[ord(c)])
    while a > 0 and within(text[a - 1]):
        a -= 1
    while b < len(text) and within(text[b]):
        b += 1
    return a, b


def resolve(kind: str, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The spans of this kind within a grown span: parts of it, which begin and end with words or with marks that the kind allows
    around it, are tried from the left, the longest first."""
    s = text[a:b]
    out = []
    if kind in ("email", "secret"):
        for m in (_email_like if kind == "email" else _secret_like).finditer(s):
            x, y = m.span()
            while y > x and s[y - 1] in ".-=" and kind == "email":
                y -= 1
            if fits(kind, s[x:y]):
                out.append((a + x, a + y))
        return out
    # numbers: parts begin at a number (or the marks before it) and end at one
    runs = [m.span() for m in re.finditer("[0-9]+", s)]
    most = {"ip": 12, "card": 19, "phone": 15}[kind]
    i = 0
    while i < len(runs):
        digits, best = 0, None
        for j in range(i, len(runs)):
            digits += runs[j][1] - runs[j][0]
            if digits > most:
                break
            for before in (("+ (", "+(", "+", "(", "") if kind == "phone" else ("",)):
                x = runs[i][0] - len(before)
                if x >= 0 and s.startswith(before, x) and fits(kind, s[x : runs[j][1]]):
                    best = (a + x, a + runs[j][1], j)
                    break
        if best:
            out.append(best[:2])
            i = best[2] + 1
        else:
            i += 1
    return out


def _generator(rng: random.Random):
    """Makers of words, of labelled spans by kind, and of what is not personal data."""
    syl = ["th", "er", "an", "in", "on", "ei", "ch", "ung", "la", "que", "é", "ción", "os", "ß", "ment", "ly", "st", "ra", "do"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    plain = lambda: word().encode("ascii", "ignore").decode() or "x"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def number() -> str:
        d = num(rng.choice((12, 13, 14, 15, 15, 15, 15, 17)))
        return d + next(c for c in "0123456789" if luhn(d + c))

    def card() -> str:
        d = number()
        mark = rng.choice(("", " ", ".", "-", "/"))
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        local = rng.choice((plain(), plain() + rng.choice("._") + plain(), plain() + num(rng.randint(1, 3)), some("abcdefghijklmnop", rng.randint(10, 60))))
        at, dot = rng.choice((("@", "."), ("(at)", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), ("(at)", "(dot)"), (" @ ", " dot "), ("@", "[dot]")))
        return f"{local}{at}{plain()}{num(rng.randint(0, 1))}{dot}{rng.choice(('', plain() + dot))}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'io'))}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+49 {a} {b} {c}", f"0{num(2)}/{b} {c}", f"+33/{num(1)}/{num(2)}/{num(2)}/{num(2)}", f"({a})-{b}-{c}", f"1-{a}-{b}-{c}"))

    def ip() -> str:
        return rng.choice((".", "[.]", " . ", "(.)")).join(str(rng.randint(0, 255)) for _ in range(4))

    def secret() -> tuple[str, str]:
        s = rng.choice((some(hexa, 40), some(hexa, 32), some(mixed, rng.randint(20, 44)), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), rng.choice(("ghp_", "sk-", "pk_live_")) + some(mixed, 28)))
        if sum(c.isdigit() for c in s) < 3:
            s += num(3)
        name = rng.choice(("token", "key", "api_key", "secret", "password", "access_token", "auth", "apikey"))
        return name + rng.choice((" = ", "=", ": ", " ")) + rng.choice(('"', "'", "")), s

    nothing = (
        lambda: num(rng.randint(1, 6)), lambda: num(rng.randint(10, 18)), lambda: f"{rng.randint(1990, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(2)}",
        lambda: f"{rng.choice(('commit', 'sha256', 'md5', 'digest', 'hash'))} {some(hexa, rng.choice((32, 40, 64)))}", lambda: f"{num(2)}:{num(2)}", lambda: f"CC BY-NC {num(1)}.0", lambda: f"{num(3)},{num(3)}",
        lambda: f"{num(2)}.{num(2)}.{rng.randint(1990, 2030)}", lambda: f"@{word()}", lambda: f"({num(4)})", lambda: f"{num(3)} {num(3)}", lambda: f"{word()}{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(1)}-{num(1)}",
    )
    return word, {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}, nothing


def sample(rng: random.Random, chars: int, share: float = 0.3) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of at least so many characters and its labelled spans, among invented words and numbers that aren't personal data."""
    word, make, nothing = _generator(rng)
    text, spans = "", []

    def put(kind: str) -> None:
        nonlocal text
        s = make[kind]()
        if kind == "secret":
            text, s = text + s[0], s[1]
        spans.append((len(text), len(text) + len(s), kind))
        text += s

    while len(text) < chars:
        if rng.random() < share:
            if rng.random() < 0.7:
                kind = rng.choice(KINDS)
                put(kind)
                if kind == "card" and rng.random() < 0.25:
                    text += " "
                    put(kind)
                text += rng.choice(("", "", ".", ",", '"' if kind == "secret" else ""))
            else:
                text += rng.choice(nothing)()
        else:
            text += word() + rng.choice(("", "", "", ".", ",", ".\n"))
        text += " "
    return text, spans


def examples(n: int = 4000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled stretches of `T` characters."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        text, spans = sample(rng, 4 * T)
        for lo in range(rng.randint(0, T // 2), len(text) - T // 2, T):
            out.append((text[lo : lo + T], [(max(a - lo, 0), min(b - lo, T), k) for a, b, k in spans if b > lo and a < lo + T]))
    return out[:n]


def encode(rows, kinds=KINDS) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(rows), T), np.int64), np.zeros((len(rows), T), np.int64)
    for i, (text, spans) in enumerate(rows):
        c = bilstmcrf.classes(text[:T])
        x[i, : len(c)] = c
        for a, b, k in spans:
            t = 1 + 2 * kinds.index(k)
            y[i, a:b] = t + 1
            y[i, a : a + 1] = t
    return x, y


def fit(rows, steps: int = 380, seed: int = 0) -> bilstmcrf.Model:
    model = bilstmcrf.new_model(KINDS, hidden=20, seed=seed)
    bilstmcrf.train(model, *encode(rows), steps=steps, seed=seed)
    return model


@lru_cache(1)
def default_model() -> bilstmcrf.Model:
    return fit(examples())


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of whole words around the triggers, `WORDS_AROUND` on both sides."""
    at = np.array([m.start() for m in _trigger.finditer(text)], np.int64)
    if not len(at):
        return []
    space = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") <= 32
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    word = np.unique(np.searchsorted(start, at, "right") - 1)
    first = np.append(True, np.diff(word) > 2 * WORDS_AROUND)
    last = np.append(first[1:], True)
    lo, hi = np.maximum(word[first] - WORDS_AROUND, 0), np.minimum(word[last] + WORDS_AROUND, len(start) - 1)
    return list(zip(start[lo].tolist(), end[hi].tolist(), strict=True))


_central = (1 + np.minimum(np.arange(T), np.arange(T)[::-1])).astype(np.float32)[:, None]
LAID = 1 << 18  # characters whose windows are worked on at a time, or one region


def emissions(model: bilstmcrf.Model, laid: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """laid: classes of regions, each from a multiple of `T` on with zeros after it. Two sets of windows, half a window apart,
    are averaged. begins: where regions begin; the half window before one of them sees the end of another and is left out."""

    def of(x):
        rows = x.reshape(-1, T)
        parts = [model.emissions(rows[i : i + 1024].T).transpose(1, 0, 2) for i in range(0, len(rows), 1024)]
        return np.concatenate(parts).reshape(len(x), -1)

    half, n = T // 2, len(laid)
    weight = np.tile(_central, (n // T, 1))
    total = of(laid) * weight
    if n > T:
        other = np.tile(_central, (n // T - 1, 1))
        for x in begins[begins > 0]:
            other[x - T : x] = 0
        total[half : n - half] += of(laid[half : n - half]) * other
        weight[half : n - half] += other
    return total / weight


def decode(model: bilstmcrf.Model, texts: list[str], at: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, str]]]:
    """Spans of the texts' regions, as the model sees them."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    todo = [(i, a, b) for i, r in enumerate(at) for a, b in r]
    lo = 0
    while lo < len(todo):
        hi, size = lo, 0
        while hi < len(todo) and (hi == lo or size + todo[hi][2] - todo[hi][1] <= LAID):
            size += todo[hi][2] - todo[hi][1] + 2 * T
            hi += 1
        _decode_part(model, texts, todo[lo:hi], found)
        lo = hi
    return found


def _decode_part(model, texts, part, found) -> None:
    lengths = np.array([b - a for _, a, b in part])
    room = (lengths + 2 * T - 1) // T * T  # at least T - 1 zeros after each
    begins = np.cumsum(room) - room
    laid = np.zeros(int(room.sum()), np.int64)
    hold, allowed = np.zeros(len(laid), bool), np.zeros(len(laid), bool)
    for x, (i, a, b) in zip(begins.tolist(), part, strict=True):
        s = texts[i][a:b]
        laid[x : x + b - a] = bilstmcrf.classes(s)
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        allowed[x : x + b - a] = (c < 128) & _allowed[np.minimum(c, 127)]
        hold[x : x + b - a] = (c >= 48) & (c < 58) | (c == 64) | (c == 91) | (c == 40)
    e = emissions(model, laid, begins)
    # runs of allowed characters that hold a trigger
    edge = np.diff(allowed.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    seen = np.append(0, np.cumsum(hold))
    some = seen[end] > seen[start]
    start, end = start[some], end[some]
    by = np.argsort(end - start, kind="stable")
    start, end = start[by], end[by]
    trans, lo = model.transitions(), 0
    while lo < len(start):
        longest = end[lo] - start[lo]
        hi = lo + 1
        while hi < len(start) and (end[hi] - start[hi]) * (hi - lo + 1) <= 200_000 and end[hi] - start[hi] <= 2 * longest + 16:
            hi += 1
        size = end[lo:hi] - start[lo:hi]
        grid = np.minimum(start[lo:hi] + np.arange(int(size.max()))[:, None], len(e) - 1)
        tags = bilstmcrf.viterbi(e[grid], size, trans)
        for r, x in enumerate(start[lo:hi].tolist()):
            t = tags[: size[r], r]
            firsts = np.flatnonzero(t % 2 == 1)
            if len(firsts):
                k = int(np.searchsorted(begins, x, "right")) - 1
                i, shift = part[k][0], part[k][1] + x - int(begins[k])
                for p in firsts.tolist():
                    q = p + 1
                    while q < len(t) and t[q] == t[p] + 1:
                        q += 1
                    found[i].append((shift + p, shift + q, model.kinds[(int(t[p]) - 1) // 2]))
        lo = hi


def all_spans(model: bilstmcrf.Model, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    more = decode(model, texts, [regions(t) for t in texts])
    out = []
    for t, own, got in zip(texts, base, more, strict=True):
        spans = list(own)
        taken = sorted((a, b) for a, b, _ in own)
        starts, ends = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
        upto, parts = dict.fromkeys(KINDS, 0), []
        for a, b, k in sorted(got):
            if a >= upto[k]:  # else it lies in a grown span whose parts are known
                a, b = grow(k, t, a, b)
                upto[k] = b
                parts += [(x, y, k) for x, y in resolve(k, t, a, b)]
        last = -1
        for a, b, k in sorted(set(parts), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
            i = int(np.searchsorted(starts, b))  # base spans that begin before the end
            if a >= last and (i == 0 or ends[i - 1] <= a):
                spans.append((a, b, k))
                last = b
        out.append((own, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: bilstmcrf.Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added and n_spans of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added", "n_spans"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in batches:
            for i, j in _byte_groups(b.column(1)):
                some = [x or b"" for x in b.column(1).slice(i, j - i).to_pylist()]
                # most texts have neither a digit nor a sign
                use = [k for k, x in enumerate(some) if _bytes.search(x)]
                rows = [(0, 0, 0, 0, nothing, "", 0, 0)] * len(some)
                for k, (own, spans) in zip(use, all_spans(shared.value, [some[k].decode() for k in use]), strict=True):
                    n = [sum(s[2] == x for s in own) for x in BASE_KINDS]
                    rows[k] = (*n, hashlib.sha256(written(own).encode()).hexdigest(), written(spans), len(spans) - len(own), len(spans))
                cols = zip(*rows, strict=True)
                types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    body = docs[text].cast("string").cast("binary").alias("_text")
    schema = f"k {kind}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(key, body).mapInArrow(run, schema).withColumnRenamed("k", key)


_bytes = re.compile(rb"[0-9@]|[\[(]at[\])]")
