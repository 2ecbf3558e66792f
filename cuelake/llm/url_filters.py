"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed, one after the other, into the bits of a multiword Shift-And mask. All rules are simulated at once:
each canonical URL has one row of 64-bit words, and one step over a column of characters advances every rule on every
URL of a batch. A URL's state doesn't depend on other URLs, so the job is one pass with no shuffle.

Globs are matched against host + path, whole and case-sensitive: `*` is any run without "/", `**` any run, `?` any one
character. A site rule `host/path` is the two globs `host/path**` and `*.host/path**`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, lower_ascii, read_table, ship

#: (verdict, host, path): the longest rule that fits wins.
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs that block a URL which no site rule fits; any other URL is allowed.
BLOCK_GLOBS = ("*spam*/**", "*spam*", "*pills*/**", "*pills*", "*casino*/**", "*casino*", "**/wp-login.php**", "**.exe", "*.test/**")


class Automaton:
    """Shift-And over several 64-bit words for many globs."""

    def __init__(self, globs: tuple[str, ...] | list[str]):
        self.globs = tuple(globs)
        literals = sorted({c for g in globs for c in g if c not in "*?"} | {"/"})
        self.symbol = {c: i + 1 for i, c in enumerate(literals)}  # 0: any other character
        parsed = []
        for glob in globs:
            steps: list[str] = []
            loops = [""]  # of the state before each step: "", "*" or "**"
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    run = len(glob[i:]) - len(glob[i:].lstrip("*"))
                    loops[-1] = "**" if run > 1 or loops[-1] == "**" else "*"
                    i += run
                else:
                    steps.append(glob[i])
                    loops.append("")
                    i += 1
            parsed.append((steps, loops))
        bits = sum(len(steps) + 1 for steps, _ in parsed)
        self.words = max(1, -(-bits // 64))
        n = len(literals) + 1
        take = np.zeros((n, self.words), np.uint64)
        stay = np.zeros((n, self.words), np.uint64)
        start, last = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.final = []

        def put(mask: np.ndarray, bit: int) -> None:
            mask[..., bit // 64] |= np.uint64(1 << (bit % 64))

        at = 0
        slash = self.symbol["/"]
        for steps, loops in parsed:
            put(start, at)
            for k, step in enumerate(steps):
                put(take if step == "?" else take[self.symbol[step]], at + k + 1)
            for k, loop in enumerate(loops):
                if loop:
                    put(stay, at + k)
                    if loop == "*":
                        stay[slash, (at + k) // 64] &= ~np.uint64(1 << ((at + k) % 64))
            at += len(steps)
            put(last, at)
            self.final.append(at)
            at += 1
        self.take, self.stay, self.start, self.last = take, stay, start, last

    def _symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(128, np.int64)
        far = {}
        for c, i in self.symbol.items():
            if ord(c) < 128:
                table[ord(c)] = i
            else:
                far[ord(c)] = i
        out = np.where(codes < 128, table[np.minimum(codes, 127)], 0)
        for code, i in far.items():
            out[codes == code] = i
        return out

    def matches(self, urls: list[str]) -> np.ndarray:
        """A row per URL, a column per glob: whether it matches the whole URL."""
        found = np.zeros((len(urls), len(self.globs)), bool)
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(lengths, kind="stable")[::-1]
        symbols = self._symbols("".join(urls))
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(urls) else lengths
        state = np.tile(self.start, (len(urls), 1))  # row i is URL order[i], longest first
        one, top = np.uint64(1), np.uint64(63)
        lengths, begins = lengths[order], begins[order]
        for step in range(int(lengths[0]) if len(urls) else 0):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # those longer than step
            now = state[:live]
            c = symbols[begins[:live] + step]
            moved = (now & ~self.last) << one
            moved[:, 1:] |= (now[:, :-1] & ~self.last[:-1]) >> top
            state[:live] = (moved & self.take[c]) | (now & self.stay[c])
        for g, bit in enumerate(self.final):
            found[order, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return found


def filter_urls(pages: DataFrame, site_rules=SITE_RULES, block_globs=BLOCK_GLOBS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (the longest site rule that fits, else null), verdict (allow or block:
    the rule's; without a rule block if a block glob matches, else allow), block_glob (the first block glob that matches).

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. A null
    url or one without "://" has both empty and is judged as the empty URL. Of rules of one length the one given first wins.
    Repeated rows are judged each, whole URLs always, however long; an empty table gives no rows; other columns, whatever their
    names, are not read.
    """
    ship(pages.sparkSession)
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = dict(rows.dtypes)["page_id"]
    globs = [g for _, h, p in site_rules for g in (f"{h}{p}**", f"*.{h}{p}**")] + list(block_globs)
    longest = sorted(range(len(site_rules)), key=lambda i: -len(site_rules[i][1] + site_rules[i][2]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        names, blocks = pa.array([site_rules[i][1] + site_rules[i][2] for i in longest], pa.string()), pa.array(block_globs, pa.string())
        verdict = pa.array([site_rules[i][0] for i in longest] + ["block", "allow"])
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = automaton.matches([h + p for h, p in zip(hosts, paths, strict=True)])
            fits, globbed = (found[:, : 2 * len(longest)].reshape(len(found), len(longest), 2).any(axis=2)[:, longest], found[:, 2 * len(longest) :])
            first = lambda hits: np.where(hits.any(axis=1), hits.argmax(axis=1) if hits.shape[1] else 0, -1)
            rule, glob = first(fits), first(globbed)
            rules, by = names.take(pa.array(rule, mask=rule < 0)), blocks.take(pa.array(glob, mask=glob < 0))
            verdicts = verdict.take(pa.array(np.where(rule >= 0, rule, np.where(glob >= 0, -2, -1)) % len(verdict)))
            yield pa.RecordBatch.from_arrays([*batch.columns, rules, verdicts, by], ["page_id", "host", "path", "rule", "verdict", "block_glob"])

    return rows.mapInArrow(lean(judge), f"page_id {kind}, host string, path string, rule string, verdict string, block_glob string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages", "page_id", "url"))


SQL = {
    "op8_url_filters": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
u AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
  CASE
    WHEN contains(host, 'spam') THEN CASE WHEN path <> '' THEN '*spam*/**' ELSE '*spam*' END
    WHEN contains(host, 'pills') THEN CASE WHEN path <> '' THEN '*pills*/**' ELSE '*pills*' END
    WHEN contains(host, 'casino') THEN CASE WHEN path <> '' THEN '*casino*/**' ELSE '*casino*' END
    WHEN contains(host || path, '/wp-login.php') THEN '**/wp-login.php**'
    WHEN suffix(host || path, '.exe') THEN '**.exe'
    WHEN suffix(host, '.test') AND path <> '' THEN '*.test/**' END AS block_glob FROM h)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN block_glob IS NULL THEN 'allow' ELSE 'block' END END AS verdict, block_glob
FROM u"""
}
