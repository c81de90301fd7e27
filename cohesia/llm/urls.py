"""URL filters: a trie over reversed host labels, then path segments; the longest fitting rule decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's path.
Rule = tuple[str, str, str]

#: What becomes of a url that no rule fits.
DEFAULT_VERDICT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path. Both are empty for null and for a url without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Trie:
    """Nodes are dicts: ``labels`` and ``segments`` lead on, ``ends`` has the beginnings of a last, partial segment.

    A rule's path is cut at slashes. All pieces but the last must be whole segments of the url's path, and the
    next segment must begin with the last piece, which is empty in a path that ends with a slash.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            found = (len(host), len(path), host + path, verdict)
            node.setdefault("ends", {})
            node["ends"][last] = min(node["ends"].get(last, found), found, key=lambda r: r[3] != "block")

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host length, path length, rule, verdict) of the rule of the longest host, then of the longest path.

        Of two equal rules with different verdicts, block wins.
        """
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                return best
            best = self._along(node, segments) or best
        return best

    @staticmethod
    def _along(node: dict, segments: Sequence[str]) -> tuple[int, int, str, str] | None:
        best = None
        for segment in segments:
            if ends := node.get("ends"):
                fits = [found for last, found in ends.items() if segment.startswith(last)] if len(ends) < 8 else [
                    ends[segment[:n]] for n in range(len(segment) + 1) if segment[:n] in ends
                ]
                best = max(fits, key=lambda r: r[1], default=best)
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", block: int = 100_000) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row.

    rule is the deciding rule as host + path, null where none fits; the verdict is then ``DEFAULT_VERDICT``. A null
    url has an empty host and path. The trie is broadcast; it never holds more than ``block`` rules: a longer
    list is matched in blocks, one after the other, and the longest match over all blocks decides. Rows that
    repeat are judged each. Other columns are not read.
    """
    spark = pages.sparkSession
    out = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in _BEST),
    )
    for start in range(0, max(1, len(rules)), block):
        trie = spark.sparkContext.broadcast(Trie(rules[start : start + block]))
        out = out.mapInArrow(_matcher(trie), "page_id long, url string, " + ", ".join(map(" ".join, _BEST)))
    host, path = _host_path(F.col("url"))
    return out.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))


_BEST = (("host_len", "int"), ("path_len", "int"), ("rule", "string"), ("verdict", "string"))


def _matcher(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            found = []
            for url, *before in zip(*(columns[k] for k in ("url", *(name for name, _ in _BEST)))):
                best = trie.value.match(*split_url(url))
                older = before[0] is not None and (best is None or (before[0], before[1], before[3] == "block") >= (best[0], best[1], best[3] == "block"))
                found.append(before if older else best or [None] * 4)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            best = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *best], ["page_id", "url", *(name for name, _ in _BEST)])

    return run


def _host_path(url):
    """The same split as :func:`split_url`, as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring_index(F.substring_index(F.substr(url, at + 3), "?", 1), "#", 1)).otherwise("")
    host = F.substring_index(rest, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.substr(rest, F.length(host) + 1), F.lit(""))
