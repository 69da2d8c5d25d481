"""Command line: python -m quarry.cli --root STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quarry.engine import Engine, Options
from quarry.functions.text import PREVIEW
from quarry.functions.vectors import SCALES
from quarry.schema import SearchMode, SearchQuery


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--root", required=True, help="folder of the index")
    p.add_argument("--model", help="for this call; else the one chosen by models --use")
    p.add_argument("--ann", choices=("auto", "force", "off"), default="auto", help="when vectors are searched by the inverted file")
    p.add_argument("--scale", choices=SCALES, default=SCALES[0], help="of vector scores")
    p.add_argument("--strict", action="store_true", help="punctuation in a keyword query finds nothing")
    p.add_argument("--pushdown-types", action="store_true", help="filter by type before the limit")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("path")
    c.add_argument("--full-sync", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("-l", "--limit", type=int, default=10)
    c.add_argument("-o", "--offset", type=int, default=0)
    c.add_argument("-m", "--mode", default="hybrid")
    c.add_argument("-t", "--type", action="append", default=[])
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("list")
    c.add_argument("-l", "--limit", type=int, default=20)
    c.add_argument("-o", "--offset", type=int, default=0)
    sub.add_parser("stats")
    sub.add_parser("clear")
    c = sub.add_parser("models")
    c.add_argument("--use", help="the model from now on")
    c = sub.add_parser("preview")
    c.add_argument("path")
    c = sub.add_parser("remove")
    c.add_argument("id")
    c = sub.add_parser("count")
    c.add_argument("folder")
    c = sub.add_parser("watch")
    c.add_argument("log")
    c.add_argument("folder")
    c.add_argument("checkpoint")
    return p


def run(args: argparse.Namespace, spark: SparkSession, say=print) -> None:
    engine = Engine(spark, Options(args.root, args.model, ann=args.ann, scale=args.scale, strict=args.strict, pushdown_types=args.pushdown_types))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if args.command == "index":
        say(json.dumps(rows(engine.index_directory(args.path, args.full_sync))[0]))
    elif args.command == "search":
        found = rows(engine.search(SearchQuery(args.query, tuple(args.type), args.limit, args.offset, SearchMode.of(args.mode))))
        if args.json:
            say(json.dumps(found, default=str))
        for i, r in enumerate([] if args.json else found, 1):
            say(f"{i}. {r['file_record']['path']} [{r['match_type']}] {r['score']:.3f}\n   {(r['snippet'] or '')[:PREVIEW]}")
    elif args.command == "list":
        for r in rows(engine.list_files(args.limit, args.offset)):
            say(f"{r['id']} {r['file_type']} {r['path']}")
    elif args.command == "stats":
        say(json.dumps(rows(engine.stats())[0]))
    elif args.command == "clear":
        engine.clear()
    elif args.command == "preview":
        say(json.dumps(rows(engine.preview(args.path))[0]))
    elif args.command == "models":
        if args.use:
            engine.switch_model(args.use)
        say(f"in use: {engine.options.model} of {', '.join(engine.models.ids())}")
        for r in rows(engine.list_models()):
            say(f"{r['model_id']} {r['local_path']}")
    elif args.command == "remove":
        engine.remove_file(args.id)
    elif args.command == "count":
        say(engine.count_in_dir(args.folder))
    elif args.command == "watch":
        from quarry.streaming.watch import watch

        watch(engine, args.log, args.folder, args.checkpoint).awaitTermination()


def main() -> None:
    args = parser().parse_args()
    run(args, SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate())


if __name__ == "__main__":
    main()
