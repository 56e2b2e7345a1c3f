"""Personal data: base patterns, and a conditional random field over word shapes for what they miss.

The patterns find emails, IPv4 addresses, payment cards (Luhn) and international phone numbers.  The
field labels the tokens of a text (runs without white space) with B-/I- tags of the same four kinds from
their shapes, their neighbours' shapes and checks that a shape cannot make (Luhn, octets).  It adds
spans where no base span is: emails spelled with [at] and [dot], national phone numbers, cards with
dots between their groups, IPv6 addresses.  Account numbers are no cards, and bare numbers no phones without a word that says so.

Every token of every text is decoded.  A token's scores are its own, which are kept for each distinct token, and those of
its neighbours' kinds, which are tables over few kinds; so a batch of texts is scored and decoded by array operations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped
from .crf import Crf, train, viterbi

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive repeats and a look-behind: the same matches, in linear time on any text
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, from one @ to the next."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def octets(text: str) -> bool:
    """Whether all parts between dots are at most 255; leading zeros count nothing."""
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    card = (m for m in _CARD.finditer(text) if m.end() - m.start() >= 16)
    cards = [m.span() for m in card if 16 <= len(d := _DIGITS.sub("", m.group())) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15] if "+" in text else []
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if octets(m.group())],
        "card": cards,
        "phone": phones,
    }


# ---------------------------------------------------------------- features

_TOKEN = re.compile(r"[^\s]+")
_MARKED = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_EDGE = "\"'`.,;:!?*#%&$|<>~_=/\\"
_RUNS = re.compile(r"[A-Z]+|[^\W\d_A-Z]+|[0-9]+")
#: Ends of host names that a spelled-out address has.
_TOPS = frozenset(("com", "org", "net", "edu", "gov", "info"))
_CUES = {
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "ring": "phone", "telefon": "phone", "mobil": "phone", "dial": "phone",
    "email": "email", "mail": "email", "contact": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip",
}


def core(token: str) -> tuple[int, int]:
    """Start and end of a token without signs at its edges."""
    bare = token.lstrip(_EDGE)
    start = len(token) - len(bare)
    return start, start + len(bare.rstrip(_EDGE))


def _run(m: re.Match) -> str:
    c = m.group()[0]
    kind = "d" if c.isdigit() else "X" if "A" <= c <= "Z" else "x"
    return f"{kind}{min(len(m.group()), 6)}" if kind == "d" else kind


def group(token: str) -> str:
    """A token's coarse kind, as its neighbours see it."""
    a, b = core(token)
    t = token[a:b]
    if not t:
        return "sign"
    if _MARKED.search(t) is None:
        low = t.lower()
        return "bare-" + low if low in ("at", "dot") else "cue-" + _CUES[low] if low in _CUES else "top" if low in _TOPS else "word"
    if t.lower().strip("[](){}") in ("at", "dot"):
        return t.lower().strip("[](){}")
    digits = sum(c.isdigit() for c in t)
    if digits == len(t):
        return f"num{min(digits, 6)}"
    if digits + sum(c in "()-./" for c in t) == len(t):
        return "numsign"
    return "mixed"


def shape_features(token: str) -> tuple[str, ...]:
    """What a token tells by itself: its shape with run lengths, and checks of its digits."""
    a, b = core(token)
    t = token[a:b]
    digits = _DIGITS.sub("", t)
    shape = _RUNS.sub(_run, t)
    names = ["bias", "s=" + shape, "g=" + group(token)]
    if digits:
        names.append(f"n={min(len(digits), 20)}")
        if len(digits) >= 13:
            names.append(f"luhn={13 <= len(digits) <= 19 and luhn(digits)}")
        if t.count(".") == 3:
            names.append(f"octets={all(p.isdigit() for p in t.split('.')) and octets(t)}")
    if t.count(":") >= 2:
        names.append(f"hex={re.fullmatch('[0-9a-fA-F:]+', t) is not None}{min(t.count(':'), 7)}")
    if "@" in t:
        names.append(f"at={t.count('@') == 1}{'.' in t.rpartition('@')[2]}")
    elif any(c.isalpha() for c in t) and digits:
        names.append("letters+digits")
        names.append(f"run={min(len(t), 40) // 8}")
    return tuple(names)


def features(tokens: list[str], k: int) -> list[str]:
    """Feature names of token k: its shape, and the kinds of up to two tokens on either side."""
    names = list(shape_features(tokens[k]))
    here = group(tokens[k])
    for d in (-2, -1, 1, 2):
        near = group(tokens[k + d]) if 0 <= k + d < len(tokens) else "edge"
        if near not in ("word", "edge") or abs(d) == 1:
            names.append(f"{d}={near}")
            if abs(d) == 1:
                names.append(f"{d}={near}|{here}")
    return names


# ---------------------------------------------------------------- the labelled table

#: Templates of the labelled table: text, {kind} for an entity of that kind, {no} for a decoy.
TEMPLATES = (
    "please write to {email} for more of it", "{email} is where we read it", "my address is {email}, thanks",
    "the server {ip} was down again", "ping {ip} and wait", "we saw {ip} in the log of that day",
    "paid by {card} on that day", "card {card} was declined", "she gave {card} to the clerk",
    "tel. {phone} or by mail", "ring me on {phone} at noon", "phone: {phone}", "Telefon {phone} und so", "my mobile is {phone} now", "dial {phone} for help", "ring {phone} or come by", "Tel: {phone} {phone}",
    "contact: {email}", "mail {email} or tel. {phone}", "account {no} was used", "tel. is out and so is {no}", "call at {no} or so", "the {no} {no} {no} of them",
    "call {phone} after lunch", "tel {phone} or come by", "you reach us at {phone} until noon", "{phone} is my number",
    "use {phone} {ip} for that", "{card} {email} and so on", "{ip} {email} in the log", "write {email} {card} or call {phone} {email} of",
    "take {phone} {phone} or {card} {card} with", "it was {no} when we came", "version {no} of the license", "under {no} and other terms", "see {no} for that",
    "the token = \"{no}\" was kept", "we paid {no} for it", "chapter {no} of the book", "build {no} is out", "{no} is the id",
    "nothing to see here but words", "the of and to in that this with or an", "Und der die das nicht ein ist von zu",
    "she was at the house and he at home", "we met at noon near the dot", "look at com and org or at net", "a dot on the map at last", "at at at at at at", "look. At it at noon at home at last", "Then at the end. At", "dot dot dot at dot",
    "{no}", "{no} and {no} were seen", "line {no} {no}", "contact them or call again after the show", "la de que et les des une pour", "a b c and d",
    "he sold {no} of them, then {no} more", "room {no} or room {no}", "the years {no} to {no} were good",
)


class _Draw:
    """Fixed pseudo-random numbers: a linear congruential generator (Knuth's MMIX constants)."""

    def __init__(self, seed: int):
        self.state = seed

    def below(self, n: int) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % 2**64
        return (self.state >> 33) % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def one(self, *items: str) -> str:
        return items[self.below(len(items))]

    def name(self) -> str:
        return "".join(self.one("an", "ber", "co", "da", "el", "fi", "go", "hu", "ja", "ko", "li", "mo") for _ in range(1 + self.below(3)))


def _card_digits(r: _Draw, n: int = 16) -> str:
    head = r.one("4", "5", "3") + r.digits(n - 2)
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def _entity(kind: str, r: _Draw) -> str:
    if kind == "email":
        at, dot = r.one("[at]", "(at)", "{at}"), r.one("[dot]", "(dot)", "{dot}")
        return r.one(
            f"{r.name()}.{r.digits(2)}@{r.name()}.{r.one('com', 'org', 'net')}",
            f"{r.name()} {at} {r.name()} {dot} {r.one('com', 'org', 'net')}",
            f"{r.name()}{at}{r.name()}{dot}{r.one('com', 'org', 'net')}",
            f"{r.name()} {at} {r.name()}.{r.one('com', 'org', 'net')}",
            f"{r.name()}{at}{r.name()}.{r.one('com', 'de', 'fr', 'es', 'co.uk', 'io', 'eu')}",
            f"{r.name()} {at.upper()} {r.name()} {dot.upper()} {r.one('com', 'org', 'net')}",
            f"{r.name()} at {r.name()} dot {r.one('com', 'org', 'net')}",
        )
    if kind == "ip":
        v6 = ":".join(f"{r.below(65536):x}" for _ in range(8))
        return r.one(".".join(str(r.below(256)) for _ in range(4)), v6, f"{r.one('2001', 'fe80')}:{r.below(4096):x}::{r.below(4096):x}")
    if kind == "card":
        d = _card_digits(r)
        return r.one("", " ", "-", ".").join((d[:4], d[4:8], d[8:12], d[12:]))
    a, b, c = r.digits(3), r.digits(3), r.digits(4)
    if r.below(3) == 0:
        # national numbers: an area code that begins with 0, and one or two groups
        area = "0" + r.digits(2 + r.below(3))
        return r.one(f"{area} {r.digits(6 + r.below(3))}", f"{area} {r.digits(3)} {r.digits(4)}", f"{area}/{r.digits(7)}", f"({area}) {r.digits(6)}", f"{area}-{r.digits(7)}", f"{area} {r.digits(2)} {r.digits(2)} {r.digits(2)}")
    return r.one(f"+{r.digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.digits(2)} {r.digits(2)} {r.digits(8)}", f"1-{a}-{b}-{c}")


def _decoy(r: _Draw) -> str:
    long = r.digits(16)
    return r.one(
        r.digits(1 + r.below(5)), f"{1900 + r.below(130)}", f"{r.below(10)}.{r.below(10)}", f"{r.below(10)}.{r.below(30)}.{r.below(10)}",
        "".join(r.one(*"0123456789abcdef") for _ in range(40)), f"{r.digits(2)}:{r.digits(2)}", f"{r.digits(2)}:{r.digits(2)}:{r.digits(2)}",
        f"{r.digits(4)}-{r.digits(2)}-{r.digits(2)}", f"${r.digits(3)}.{r.digits(2)}", f"{r.below(100)}%", f"CC BY-NC {r.below(5)}.0",
        long if not luhn(long) else long[:-1] + str((int(long[-1]) + 1) % 10), f"{300 + r.below(600)}.{r.below(999)}.{r.below(999)}.{300 + r.below(600)}",
        " ".join((f"{r.one('DE', 'GB', 'FR')}{r.digits(2)}", *(r.digits(4) for _ in range(4)), r.digits(2))), f"{r.one('DE', 'ES')}{r.digits(20)}",
        r.digits(8), f"{r.digits(1)},{r.digits(3)}", f"{r.name()}{r.digits(2)}", f"@{r.name()}", f"{r.digits(3)} {r.digits(3)}", f"{r.digits(2)}/{r.digits(2)}/{r.digits(4)}",
    )


def labelled_sentences(per_template: int = 14, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Sentences and their tags, drawn from TEMPLATES by a fixed rule."""
    r, out = _Draw(seed), []
    for template in TEMPLATES:
        for _ in range(per_template if "{" in template else 1):
            tokens, tags = [], []
            for part in template.split():
                m = re.search(r"\{(\w+)\}", part)
                if not m:
                    tokens.append(part + r.one("", "", "", "***", "."))
                    tags.append("O")
                    continue
                value = _decoy(r) if m[1] == "no" else _entity(m[1], r)
                own = part.replace(m[0], value).split()
                tokens += own
                tags += ["O"] * len(own) if m[1] == "no" else [f"B-{m[1]}"] + [f"I-{m[1]}"] * (len(own) - 1)
            if r.below(4) == 0:
                tokens[-1] += r.one(".", ",", "!!", "***", "###")
            out.append((tokens, tags))
    return out


def labelled_table(spark: SparkSession, per_template: int = 14) -> DataFrame:
    """The small labelled table: sentence, position, token, tag."""
    rows = [(k, j, t, g) for k, (ts, gs) in enumerate(labelled_sentences(per_template)) for j, (t, g) in enumerate(zip(ts, gs, strict=True))]
    return spark.createDataFrame(rows, "sentence long, position int, token string, tag string")


def fit(table: DataFrame, max_tokens: int = 50_000) -> Crf:
    """Trains on a labelled table (sentence, position, token, tag), at most its first max_tokens rows."""
    rows = table.orderBy("sentence", "position").limit(max_tokens).collect()
    sentences: dict[int, tuple[list[str], list[str]]] = {}
    for row in rows:
        tokens, tags = sentences.setdefault(row["sentence"], ([], []))
        tokens.append(row["token"])
        tags.append(row["tag"])
    seen = [[features(ts, k) for k in range(len(ts))] for ts, _ in sentences.values()]
    return train(seen, [gs for _, gs in sentences.values()], LABELS)


class Field:
    """A trained field with its scores by token and by kind.

    Scores of at most cache_tokens distinct tokens are kept; longer ones than cache_chars are scored each time.
    """

    def __init__(self, crf: Crf, cache_tokens: int = 200_000, cache_chars: int = 64):
        self.crf, self.cache_tokens, self.cache_chars = crf, cache_tokens, cache_chars
        self.kinds = ["edge", "sign", "word", "top", "at", "dot", "bare-at", "bare-dot", "numsign", "mixed", *(f"num{n}" for n in range(1, 7)), *sorted({f"cue-{k}" for k in _CUES.values()})]
        where = {k: n for n, k in enumerate(self.kinds)}
        self.kind = where.__getitem__
        one = lambda *names: crf.scores(list(names))
        # by distance: scores of a neighbour of each kind; for those beside, with the token's own kind
        self.far = {d: np.array([one(f"{d}={k}") if k not in ("word", "edge") else one() for k in self.kinds]) for d in (-2, 2)}
        self.beside = {d: np.array([[one(f"{d}={k}", f"{d}={k}|{here}") for here in self.kinds] for k in self.kinds]) for d in (-1, 1)}
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.words: dict[tuple[str, str], np.ndarray] = {}
        self.own, self.own_kind = np.zeros((1024, len(self.crf.labels))), np.zeros(1024, dtype=np.int64)

    def _own(self, token: str) -> tuple[np.ndarray, int]:
        """A token's own scores and its kind; letters alone tell no more than their shape and kind."""
        t = token.strip(_EDGE)
        if not t.isalpha():
            return self.crf.scores(list(shape_features(token))), self.kind(group(token))
        low = t.lower()
        kind = "word" if low not in _CUES and low not in _TOPS and low not in ("at", "dot") else group(token)
        shape = "x" if t.islower() else "Xx" if "A" <= t[0] <= "Z" and t[1:].islower() else _RUNS.sub(_run, t)
        if (shape, kind) not in self.words:
            self.words[shape, kind] = self.crf.scores(list(shape_features(token)))
        return self.words[shape, kind], self.kind(kind)

    def _known(self, texts: list[list[str]]) -> np.ndarray:
        """The rows of all tokens of the texts; new tokens get one."""
        if len(self.rows) > self.cache_tokens:
            self._clear()
        new = set().union(*texts).difference(self.rows)
        need = len(self.rows) + len(new)
        if need > len(self.own):
            grown = max(need, 2 * len(self.own))
            self.own = np.concatenate([self.own, np.zeros((grown - len(self.own), self.own.shape[1]))])
            self.own_kind = np.concatenate([self.own_kind, np.zeros(grown - len(self.own_kind), dtype=np.int64)])
        for k, token in enumerate(new, len(self.rows)):
            self.own[k], self.own_kind[k] = self._own(token)
            self.rows[token] = k
        get = self.rows.__getitem__
        out = np.fromiter((get(t) for tokens in texts for t in tokens), dtype=np.int64, count=sum(map(len, texts)))
        if any(len(t) > self.cache_chars for t in new):
            kept = [t for t in self.rows if len(t) <= self.cache_chars]
            self._next = (kept, [self.rows[t] for t in kept])
        else:
            self._next = None
        return out

    def _forget_long(self) -> None:
        if self._next:
            kept, rows = self._next
            self.own, self.own_kind = self.own[rows], self.own_kind[rows]
            self.rows = {t: k for k, t in enumerate(kept)}

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label scores of every token of each text."""
        rows = self._known(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        # two places of no token stand between texts
        place = np.arange(len(rows)) + np.repeat(2 * np.arange(1, len(texts) + 1), lengths)
        kinds = np.zeros(len(rows) + 2 * len(texts) + 2, dtype=np.int64)
        here = self.own_kind[rows]
        kinds[place] = here
        out = self.own[rows]
        for d in (-2, 2):
            out += self.far[d][kinds[place + d]]
        for d in (-1, 1):
            out += self.beside[d][kinds[place + d], here]
        self._forget_long()
        return np.split(out, np.cumsum(lengths)[:-1]) if len(texts) else []


_FIELDS: dict[int, Field] = {}


def field_of(crf: Crf) -> Field:
    """The process's tables of a field."""
    if id(crf) not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[id(crf)] = Field(crf)
    return _FIELDS[id(crf)]


def field_spans(texts: list[str], crf: Crf) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the field's entities in each text, in order: Viterbi paths over all tokens."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    tokens = [t.split() for t in texts]
    owners = [k for k, t in enumerate(tokens) if t]
    paths = viterbi(field_of(crf).scores([tokens[k] for k in owners]), crf.labels, crf.move, crf.first, np.zeros(len(crf.labels)))
    for owner, path in zip(owners, paths, strict=True):
        if not path.any():
            continue
        text, kind, start, end = texts[owner], None, 0, 0
        for m, label in zip([*_TOKEN.finditer(text), None], [*path, 0], strict=True):
            name = LABELS[label]
            if kind and name != f"I-{kind}":
                x, y = core(text[start:end])
                if x < y:
                    out[owner].append((kind, start + x, start + y))
                kind = None
            if name != "O":
                if kind is None:
                    kind, start = name[2:], m.start()
                end = m.end()
    return out


def all_spans(texts: list[str], crf: Crf) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """The base spans of each text, and those that the field adds: none overlaps a base span."""
    out = []
    for text, extra in zip(texts, field_spans(texts, crf), strict=True):
        base = base_spans(text)
        taken = sorted(s for spans in base.values() for s in spans)
        starts = np.array([a for a, _ in taken])
        # base spans of different kinds may overlap: the farthest end so far
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0)
        out.append((base, [x for x in extra if (k := int(np.searchsorted(starts, x[2]))) == 0 or ends[k - 1] <= x[1]]))
    return out


def find_pii(docs: DataFrame, crf: Crf, batch_texts: int = 512) -> DataFrame:
    """One row per row of docs (doc_id, text): base counts, the digest of base spans, and all spans.

    Spans are kind:start:end, by kind as in KINDS and then by start, in code points, end exclusive.  A null
    or empty text has none.  Other columns are not read; repeated rows give repeated results; a null doc_id
    stays null.  Texts are read whole, batch_texts at a time.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(crf)  # features x labels of a bounded table
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def join(spans: dict[str, list[tuple[int, int]]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_texts):
                part = batch.slice(at, batch_texts)
                rows = []
                for doc, (base, extra) in zip(part.column(0).to_pylist(), all_spans(part.column(1).to_pylist(), model.value), strict=True):
                    full = {k: [*base[k], *((a, b) for kind, a, b in extra if kind == k)] for k in KINDS}
                    digest = hashlib.sha256(join(base).encode()).hexdigest()
                    rows.append((doc, *(len(base[k]) for k in KINDS), digest, join(full), len(extra)))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(source, task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
