"""Command line: index, query, serve, send and interactive."""

from __future__ import annotations

import argparse
import os
import sys

from abundex.operators.lookup import FORMATS, check_format
from abundex.plans.index import build_index, load_index
from abundex.plans.sinks import output_path, run_tag, write_tsv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="abundex", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index the datasets of a file of files")
    i.add_argument("-f", "--fof", required=True)
    i.add_argument("-o", "--output")
    i.add_argument("-k", type=int, default=31)
    mode = i.add_mutually_exclusive_group()
    mode.add_argument("--nocount", dest="mode", action="store_const", const="presence")
    mode.add_argument("--quantization", dest="mode", action="store_const", const="quantized")
    mode.add_argument("--log-count", dest="mode", action="store_const", const="log")
    i.add_argument("--reads", action="store_true", help="the files are raw reads")
    i.add_argument("-p", "--paired-end", action="store_true")
    i.add_argument("--min-abundance", type=int, default=2)
    i.add_argument("--saturate", type=int)
    i.add_argument("--monotigs", help="also write every k-mer's counts to this folder")
    q = sub.add_parser("query", help="answer the queries of a FASTA file")
    for x in (q, sub.add_parser("interactive", help="answer files named on standard input, `path [threshold]`")):
        x.add_argument("-l", "--index", required=True)
        x.add_argument("-P", "--threshold", type=int, default=40)
        x.add_argument("-F", "--format", default="raw", help=f"one of {', '.join(FORMATS)}, or its first letter")
        x.add_argument("-o", "--output")
        x.add_argument("--mem-query", action="store_true", help="hold the index in memory")
    q.add_argument("-q", "--queries", required=True)
    s = sub.add_parser("serve", help="answer commands on a port")
    s.add_argument("-l", "--index", required=True)
    s.add_argument("--port", type=int, required=True)
    c = sub.add_parser("send", help="send the commands of a file, or standard input, to a server")
    c.add_argument("--port", type=int, required=True)
    c.add_argument("-i", "--input")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("abundex").getOrCreate()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "send":
        from abundex.streaming.server import send

        lines = open(a.input).read().splitlines() if a.input else sys.stdin.read().splitlines()
        print("\n".join(send([x for x in lines if x.strip()], a.port)))
        return 0
    spark = _session()
    if a.command == "index":
        out = a.output or f"abundex_index_{run_tag()}"
        index = build_index(spark, a.fof, a.k, a.mode or "exact", a.reads or a.paired_end, a.paired_end, a.min_abundance, a.saturate)
        index.save(out)
        if a.monotigs:
            load_index(spark, out).export_monotigs().write.text(a.monotigs)
        print(out)
        return 0
    index = load_index(spark, a.index)
    if a.command == "serve":
        from abundex.streaming.server import Service, serve

        serve(Service(index.cache(), os.path.basename(a.index.rstrip("/"))), a.port)
        return 0
    if a.mem_query:
        index.cache()
    a.format = check_format(a.format)
    if a.command == "query":
        path = output_path(a.output, a.queries, a.threshold)
        write_tsv(index.query_file(a.queries, a.format, a.threshold), index.datasets, path)
        print(path)
        return 0
    empty = counter = 0
    for line in sys.stdin:
        words = line.split()
        empty = 0 if words else empty + 1
        if empty == 2:
            break
        if words:
            threshold = int(words[1]) if len(words) > 1 else a.threshold
            path = output_path(a.output, words[0], threshold, counter)
            counter += 1
            write_tsv(index.query_file(words[0], a.format, threshold), index.datasets, path)
            print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
