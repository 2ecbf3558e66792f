"""python -m cuelake: build, update, search and scan stored corpora."""

from __future__ import annotations

import argparse
import time
import traceback

from pyspark.sql import SparkSession

from cuelake.operators import documents, report
from cuelake.plans.index import Index
from cuelake.plans.query import Query
from cuelake.sources import corpus as corpora
from cuelake.sources import subtitles


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cuelake", description=__doc__)
    kinds = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "update"):
        one = kinds.add_parser(name, help=f"{name} a corpus from subtitle files")
        one.add_argument("corpus")
        source = one.add_mutually_exclusive_group(required=True)
        source.add_argument("--folder", help="a folder of files, in the order of their names")
        source.add_argument("--manifest", help='lines of "name<tab>path", in their order')
        if name == "update":
            one.add_argument("--skip-existing-names", action="store_true")
    one = kinds.add_parser("search", help="run a query, or read queries line by line")
    one.add_argument("corpus")
    one.add_argument("-s", dest="silent", action="store_true", help="only count")
    one.add_argument("-c", dest="context", type=int, default=3, help="tokens on each side (default: 3)")
    one.add_argument("query", nargs="*")
    one = kinds.add_parser("scan", help="count all tokens")
    one.add_argument("corpus")
    one.add_argument("-j", dest="cores", type=int, help="cores of a local session (default: all)")
    one.add_argument("--limit", type=int, help="only documents with ids under this")
    return parser.parse_args(args)


def run_search(index: Index, raw: str, context: int, silent: bool) -> None:
    query = Query(raw)
    print(f"Estimated cost (% of postings looked at): {100 * query.estimate_cost(index.corpus.lexicon):.4g}")
    began = time.time()
    found = query.execute(index.corpus)
    if not silent:
        rows = report.in_context(index.corpus, found, context).join(index.corpus.documents.select("doc_id", "name"), "doc_id")
        last = None
        for r in rows.orderBy("doc_id", "idx").toLocalIterator():
            if r["doc_id"] != last:
                print(r["name"])
                last = r["doc_id"]
            place = str(r["idx"]) if r["len"] == 1 else f"{r['idx']}-{r['idx'] + r['len']}"
            print(f'  [{r["interval"]}] [position: {place}] "{r["context"]}"')
    total = report.summary(found).first()
    print(f"Found {total['documents']} documents, {total['occurrences']} occurrences, spanning {total['seconds']}s in {1000 * (time.time() - began):.0f}ms")


def converse(index: Index, context: int, silent: bool, read=input) -> None:
    """Read queries until the input ends; an error is shown and the next one is read."""
    print("Enter a query:")
    while True:
        try:
            raw = read("> ").strip()
        except (EOFError, KeyboardInterrupt):
            print()
            return
        if raw:
            try:
                run_search(index, raw, context, silent)
            except Exception:
                traceback.print_exc()


def ingest(spark: SparkSession, path: str, folder: str | None, manifest: str | None, number: int | None = None, skip_existing: bool = False) -> corpora.Corpus:
    """Build a corpus of subtitle files at `path`, or append to it as the given number. Files that aren't UTF-8 are left out, with
    a line each; their names stay documents without lines."""
    if manifest:
        listed = subtitles.read_manifest(spark, manifest)
        files, names = subtitles.read_listed(spark, listed), subtitles.in_order(listed)
    else:
        files = subtitles.list_files(spark, folder)
        names = subtitles.named(files.select("name"))
    good, bad = subtitles.decoded(files)
    for (name,) in bad.select("name").toLocalIterator():
        print(f"not UTF-8: {name}")
    cues = subtitles.parse(good)
    if number is None:
        return corpora.build_stored(names, cues.join(names, "name"), path)
    return corpora.append(spark, path, names, cues, number, skip_existing)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    cores = getattr(a, "cores", None)
    builder = SparkSession.builder.appName("cuelake")
    spark = (builder.master(f"local[{cores}]") if cores else builder).getOrCreate()
    began = time.time()
    if a.command in ("build", "update"):
        number = None if a.command == "build" else int(began * 1000)
        made = ingest(spark, a.corpus, a.folder, a.manifest, number, getattr(a, "skip_existing_names", False))
        print(f"{made.documents.count()} documents, {made.lexicon.count()} words in {1000 * (time.time() - began):.0f}ms")
    elif a.command == "scan":
        total = documents.scan(corpora.load(spark, a.corpus), a.limit).first()
        print(f"Scanned {total['n_docs']} documents for {total['n_tokens']} tokens in {1000 * (time.time() - began):.0f}ms")
    else:
        with Index.open(spark, a.corpus) as index:
            if a.query:
                run_search(index, " ".join(a.query), a.context, a.silent)
            else:
                converse(index, a.context, a.silent)


if __name__ == "__main__":
    main()
