"""URL filters: base rules on hosts and paths, and glob rules matched by a bit-parallel automaton.

Every glob rule is a run of bits in a vector of 64-bit words: a start bit, then one bit for each of its
characters.  For all URLs of a batch at once, a step reads one byte of each URL and moves every active
bit of every rule:

    state = ((state << 1) & takes[byte]) | (state & loops)

takes[byte] has the bits whose character fits the byte, loops the bits after which a `*` stands, which
stay.  The carry of the shift runs through the words, and start bits take no byte, so rules do not
run into each other.  The work is (longest URL) steps of a few numpy operations, whatever the rules are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mapped

#: (verdict, host, path): a rule fits its host and all its subdomains, where the path starts with its own.
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: What junk hosts and paths are called, in a label of a host or a part of a path.
JUNK = (
    "adult", "bet", "bets", "betting", "bingo", "casino", "casinos", "cheap-pills", "coupon", "coupons", "dating", "escort", "escorts", "free-bets", "free-money",
    "gambling", "jackpot", "link-farm", "loans", "lottery", "payday", "pharmacy", "pills", "poker", "porn", "replica", "roulette", "seo-links", "slots",
    "spam", "spam-farm", "viagra", "warez", "xxx",
)
ADS = ("ad", "ads", "adserver", "advert", "adverts", "banner", "banners", "beacon", "click", "clicks", "counter", "pixel", "popup", "sponsor", "track", "tracker", "tracking")
#: Pages that hold forms and not texts, and files that are no pages.
FORMS = ("account", "admin", "basket", "cart", "checkout", "login", "logout", "register", "search", "signin", "signup", "subscribe", "wishlist", "wp-admin", "wp-login.php")
FILES = ("7z", "apk", "avi", "bin", "css", "dmg", "exe", "gif", "gz", "ico", "iso", "jpeg", "jpg", "js", "mp3", "mp4", "msi", "png", "rar", "rss", "svg", "tar", "woff", "zip")
#: Parameters of copies of a page: who sent the reader, and whose session it is.
COPIES = ("fbclid", "gclid", "jsessionid", "msclkid", "phpsessid", "replytocom", "sessionid", "sid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


def glob_rules() -> tuple[tuple[str, str], ...]:
    """(verdict, glob) on canonical URLs: `*` any bytes, `?` one byte.  Every name above in every place that it may have."""
    places = {
        ("{}.*", "{}-*", "*.{}.*", "*.{}-*", "*-{}.*", "*/{}", "*/{}/*", "*/{}-*"): JUNK + ADS,
        ("*/{}", "*/{}/*", "*/{}?*"): FORMS,
        ("*.{}", "*.{}?*"): FILES,
        ("*?{}=*",): COPIES,  # one byte before the name: ? or &
    }
    blocks = [("block", form.format(name)) for forms, names in places.items() for form in forms for name in names]
    return (*blocks, *(("allow", g) for g in ("*/robots.txt", "docs.*", "*.docs.*", "*.edu/*", "*.gov/*")))


GLOB_RULES = glob_rules()


class GlobAutomaton:
    """All globs of a rule list, packed into one multiword Shift-And automaton."""

    def __init__(self, globs: Sequence[str]):
        takes, loops, starts, ends = [], [], [], []
        for glob in globs:
            starts.append(len(takes))
            takes.append(None)
            loops.append(False)
            for byte in glob.encode():
                if byte == ord("*"):
                    loops[-1] = True
                else:
                    takes.append(-1 if byte == ord("?") else byte)
                    loops.append(False)
            ends.append(len(takes) - 1)
        self.words = max(1, -(-len(takes) // 64))
        self.takes = np.zeros((256, self.words), dtype=np.uint64)
        for k, byte in enumerate(takes):
            if byte is not None:
                self.takes[slice(None) if byte < 0 else byte, k // 64] |= np.uint64(1 << k % 64)
        self.loops = self._mask(k for k, x in enumerate(loops) if x)
        self.starts = self._mask(starts)
        self.ends = ends

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1 << k % 64)
        return out

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of booleans for each text: which globs match the whole of it."""
        n = len(texts)
        order = np.argsort([-len(t) for t in texts], kind="stable")  # those that go on stand first
        lengths = np.array([len(texts[k]) for k in order], dtype=np.int64)
        data = np.frombuffer(b"".join(texts[k] for k in order), dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.tile(self.starts, (n, 1))
        live = n
        for j in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= j:
                live -= 1
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.takes[data[begins[:live] + j]]
            state[:live] = moved | (now & self.loops)
        out = np.zeros((n, len(self.ends)), dtype=bool)
        for r, k in enumerate(self.ends):
            out[order, r] = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first :// and /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    known = url.isNotNull() & url.contains("://")
    rest = F.expr("substr({0}, instr({0}, '://') + 3)".format("url"))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, lower_ascii(host)).otherwise(""), F.when(known, path).otherwise("")


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host, path and what follows a ?, without the fragment, A-Z lower-cased; empty where the host is."""
    query = F.regexp_extract(F.expr("substr({0}, instr({0}, '://') + 3)".format("url")), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(url.isNotNull() & url.contains("://"), lower_ascii(F.concat(host, path, query))).otherwise("")


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def glob_verdicts(pages: DataFrame, globs=GLOB_RULES) -> DataFrame:
    """Puts glob_verdict in place of url_key, the canonical URL: allow where an allow glob matches or no block glob does."""
    automaton = GlobAutomaton([g for _, g in globs])
    allows = np.array([v == "allow" for v, _ in globs])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = automaton.match([x.encode() for x in batch.column("url_key").to_pylist()])
            batch = batch.drop_columns(["url_key"])
            blocked = hits[:, ~allows].any(axis=1) & ~hits[:, allows].any(axis=1)
            verdict = pa.array(np.where(blocked, "block", "allow"), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, verdict], [*batch.schema.names, "glob_verdict"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "url_key")
    return mapped(pages, task, f"{fields}, glob_verdict string")


def judge(pages: DataFrame, rules=BASE_RULES, globs=GLOB_RULES) -> DataFrame:
    """One row per row of pages (page_id, url): host, path, the base rule or null, and the verdict.

    The longest base rule that fits decides, else the globs, which see host, path and query.  A null url or one without :// has an empty
    host and path, and is judged as such; repeated rows are judged alike; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("url_key", canonical(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    rule, verdict = base_rule(F.col("host"), F.col("path"), rules)
    return glob_verdicts(parts, globs).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "glob_verdict").alias("verdict"))


def judge_sql(rules=BASE_RULES, globs=GLOB_RULES) -> str:
    """The same in DuckDB SQL."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    like = lambda g: g.replace("_", r"\_").replace("%", r"\%").replace("*", "%").replace("?", "_")
    any_of = lambda what: " OR ".join(f"url_key LIKE '{like(g)}' ESCAPE '\\'" for v, g in globs if v == what) or "false"
    az = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    known = "url IS NOT NULL AND instr(url, '://') > 0"
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN {known} THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, {az("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, rest FROM cut),
    keyed AS (SELECT *, {az("host || path || regexp_extract(rest, '^[^?#]*([?][^#]*)', 1)")} AS url_key FROM parts)
    SELECT page_id, host, path,
      CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)} END AS rule,
      CASE {" ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)}
           WHEN ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END AS verdict
    FROM keyed"""
