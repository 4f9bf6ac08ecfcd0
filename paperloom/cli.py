"""Command line: ``parse``, ``ingest`` and ``query``."""

from __future__ import annotations

import argparse
import importlib

from paperloom.plans import ingest, qa
from paperloom.session import get_session, write_through
from paperloom.sources import readers, writers


def _extractor(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="paperloom")
    parser.add_argument("--config", help="YAML settings")
    commands = parser.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="documents to pages")
    parse.add_argument("--input", required=True)
    parse.add_argument("--output", required=True)
    parse.add_argument("--extractor", required=True, help="module:Class of a page extractor")
    parse.add_argument("--page-from", type=int, default=0)
    parse.add_argument("--page-to", type=int)
    load = commands.add_parser("ingest", help="pages to an indexed collection")
    load.add_argument("--input", required=True)
    load.add_argument("--output", required=True)
    load.add_argument("--extractor")
    load.add_argument("--skip-parsing", action="store_true", help="input holds parsed JSON")
    load.add_argument("--skip-chunking", action="store_true", help="go on from the stored chunks")
    ask = commands.add_parser("query", help="answer questions")
    ask.add_argument("--collection", required=True)
    ask.add_argument("--question", action="append", required=True)
    ask.add_argument("--mode", choices=["rrf", "concat"], default="rrf")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    config = readers.read_config(args.config) if args.config else {}
    spark = get_session()
    if args.command == "parse":
        documents = readers.read_documents(spark, args.input)
        found = readers.try_extract_pages(documents, _extractor(args.extractor), args.page_from, args.page_to)
        found = write_through(found, "parsed")
        writers.write_pages(found.where("error IS NULL").drop("path", "error"), args.output)
        for row in found.where("error IS NOT NULL").select("path", "error").toLocalIterator():
            print(f"not parsed: {row['path']}: {row['error']}")
    elif args.command == "ingest":
        ingest.run_ingestion(
            spark, args.input, args.output, _extractor(args.extractor), config, args.skip_parsing,
            skip_chunking=args.skip_chunking,
        )
    else:
        collection = ingest.load_collection(spark, args.collection)
        rows = list(enumerate(args.question))
        questions = spark.createDataFrame(rows, "query_id bigint, query string")
        retriever = config.get("retriever", {})
        settings = qa.Settings(
            top_k=retriever.get("top_k", 20),
            rerank_top_k=retriever.get("rerank_top_k", 5),
            rewrite=config.get("query_rewrite", {}).get("strategy", "expand")
            if config.get("query_rewrite", {}).get("enable", True)
            else "none",
            mode=args.mode,
        )
        answers, sources = qa.answer_questions(collection, questions, settings=settings)
        for row in answers.orderBy("query_id").collect():
            print(f"Q: {row['query']}\nA: {row['answer']}\nconfidence: {row['confidence']:.3f}")
        sources.orderBy("query_id", "rank").show(truncate=60)


if __name__ == "__main__":
    main()
