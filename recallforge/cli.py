"""Command line: ``python -m recallforge.cli [--rack PATH] VERB ...``."""

from __future__ import annotations

import argparse
import sys

from .api import Rack
from .functions import text
from .operators import graph, skills, units
from .session import session
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recallforge")
    p.add_argument("--rack", default="./rack")
    p.add_argument("--master", default=None)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple, **options) -> None:
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        for k, d in options.items():
            v.add_argument(f"--{k.replace('_', '-')}", type=type(d) if d is not None else str, default=d)

    verb("teach", "content", key=None, kind="fact", cartridge=None)
    verb("search", "query", top_k=3, kind=None, cartridge=None)
    verb("ingest", "path", kind="fact", cartridge=None)
    verb("pack-skills", "path", cartridge="skills")
    verb("init", "folder", cartridge="project")
    verb("stats")
    verb("compact")
    verb("export", "path", form="json")
    verb("diff", "other")
    verb("pii")
    verb("blast", "folder", "name", depth=3)
    verb("symbols", "folder", "query")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("recallforge", a.master)
    r = Rack(spark, a.rack)
    show = lambda df: df.show(100, truncate=120)
    if a.verb == "teach":
        print(r.teach(a.content, a.key, kind=a.kind, cartridge=a.cartridge))
    elif a.verb == "search":
        show(r.search([a.query], a.top_k, a.kind, [a.cartridge] if a.cartridge else None).orderBy("rank").select("rank", "confidence", "mode", "cartridge", "content"))
    elif a.verb == "ingest":
        print(r.add(readers.items(readers.lines(spark, a.path)), kind=a.kind, cartridge=a.cartridge))
    elif a.verb == "pack-skills":
        cards = readers.cards(spark, [row.value for row in spark.read.text(a.path, wholetext=True).collect()])
        found = skills.validate(cards.withColumn("card_id", text.F.monotonically_increasing_id()))
        show(found)
        if found.filter("severity = 'error'").isEmpty():
            print(r.add(skills.entries(cards).drop("entry_id"), cartridge=a.cartridge))
        else:
            return 1
    elif a.verb == "init":
        print(r.add(units.extract(readers.project_files(spark, a.folder)).select("content", "key", "source"), kind="fact", cartridge=a.cartridge))
    elif a.verb == "stats":
        show(r.stats())
    elif a.verb == "compact":
        r.compact()
    elif a.verb == "export":
        r.export(a.path, a.form)
    elif a.verb == "diff":
        show(r.diff(Rack(spark, a.other)))
    elif a.verb == "pii":
        show(r.scan_pii())
    else:
        files = readers.project_files(spark, a.folder)
        files = files.withColumn("language", text.language_of(files.path)).filter("language is not null").withColumn("content", files.content.cast("string"))
        s, e = graph.build(files)
        if a.verb == "symbols":
            show(graph.search_symbols(s, a.query))
        else:
            show(graph.blast_radius(e, graph.resolve(s, a.name).select("id"), a.depth))
    return 0


if __name__ == "__main__":
    sys.exit(main())
