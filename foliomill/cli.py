"""The engine on the command line: ``python -m foliomill.cli ingest folder PATH`` and so on. Answers are printed one JSON object a line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from foliomill.service import Engine
from foliomill.settings import Settings
from foliomill.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliomill")
    out.add_argument("--database", default="default")
    out.add_argument("--data-root", default="data")
    groups = out.add_subparsers(dest="group", required=True)

    def command(parent: argparse._SubParsersAction, name: str, *arguments: tuple[str, dict]) -> None:
        one = parent.add_parser(name)
        one.set_defaults(command=name)
        for flag, options in arguments:
            one.add_argument(flag, **options)

    collection, force = ("--collection", {"default": "literature"}), ("--force-ocr", {"action": "store_true"})
    ingestion = groups.add_parser("ingest").add_subparsers(required=True)
    command(ingestion, "file", ("path", {}), collection, force)
    command(ingestion, "folder", ("path", {}), collection, force)
    command(ingestion, "reselect-text", ("target", {"nargs": "?", "default": "all"}))
    command(ingestion, "text-layers", ("article_id", {}))
    command(ingestion, "doctor")
    classification = groups.add_parser("classify").add_subparsers(required=True)
    command(classification, "all", collection)
    command(classification, "report", collection)
    evaluation = groups.add_parser("evaluate").add_subparsers(required=True)
    command(evaluation, "retrieval", ("questions_path", {}), collection, ("--top-k", {"type": int, "default": 10}))
    command(groups, "search", ("query", {}), collection, ("--top-k", {"type": int, "default": 10}))
    return out


def run(engine: Engine, arguments: Sequence[str], say=print) -> int:
    """Runs one command; the exit code is 1 for a wrong argument, an empty folder or a failed file."""
    a = parser().parse_args(arguments)
    tell = lambda x: say(json.dumps(x, ensure_ascii=False, default=str))
    rows = lambda df: (r.asDict() for r in df.toLocalIterator())
    try:
        if a.command == "file":
            result = engine.ingest_file(a.path, a.collection, a.force_ocr)
            tell(result)
            return int(result["status"] == "failed")
        if a.command == "folder":
            results, summary = engine.ingest_folder(a.path, a.collection, a.force_ocr)
            for r in rows(results):
                tell(r)
            tell({"summary": summary})
            return int(summary["failed"] > 0)
        if a.command in ("reselect-text", "all"):
            done = list(map(_told(tell), rows(engine.reselect(a.target) if a.command == "reselect-text" else engine.classify(a.collection))))
            tell({"summary": {"target": a.target, "articles": len(done)} if a.command == "reselect-text" else {"collection": a.collection, "classified": len(done)}})
        elif a.command == "text-layers":
            title = engine.articles_of(a.article_id).first().title
            tell({"article_id": a.article_id, "title": title, "layers": list(rows(engine.text_layers(a.article_id)))})
        elif a.command == "doctor":
            tell(engine.doctor())
        elif a.command in ("report", "retrieval"):
            report = engine.report(a.collection) if a.command == "report" else engine.evaluate(a.questions_path, a.collection, a.top_k)
            prefix = "classification_report" if a.command == "report" else "retrieval_eval"
            tell({"output_path": str(files.write_report(report, engine.settings.data_root, prefix)), "summary": report["summary"]})
        else:
            tell(engine.search(a.query, a.collection, a.top_k))
    except (ValueError, FileNotFoundError) as e:
        tell({"error_type": type(e).__name__, "error": str(e)})
        return 1
    return 0


def _told(tell):
    def one(row: dict) -> dict:
        tell(row)
        return row

    return one


def main() -> None:
    from pyspark.sql import SparkSession

    known, _ = parser().parse_known_args()
    sys.exit(run(Engine(SparkSession.builder.appName("foliomill").getOrCreate(), Settings(data_root=known.data_root), known.database), sys.argv[1:]))


if __name__ == "__main__":
    main()
