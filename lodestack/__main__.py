"""Command line: ``python -m lodestack COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import pathlib
import sys


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lodestack")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, told: str, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=told)
        for x in paths:
            p.add_argument(x)
        return p

    command("recover", "read containers and publish what their bytes prove", "source", "output").add_argument("--dataset")
    command("survey", "datasets, and what can't be read", "source")
    command("links", "links of all groups", "source")
    command("markers", "places of the format's signatures", "source")
    command("verify", "check a published result", "output")
    command("plan", "plan the repair of fixed-array pointers of one file", "source")
    command("apply", "write a repaired copy", "source", "plan", "output")
    command("query", "run a query of the catalogue", "name", "tables")
    command("capabilities", "what this build reads and decodes")
    got = top.parse_args(args)

    if got.command == "capabilities":
        from . import api

        print(json.dumps(api.capabilities(), indent=1))
        return 0
    if got.command in ("plan", "apply"):
        from .sources import repair

        data = pathlib.Path(got.source).read_bytes()
        if got.command == "plan":
            print(json.dumps(repair.plan(data, repair.find(data)), indent=1))
            return 0
        to = pathlib.Path(got.output)
        with to.open("xb") as f:  # never over something
            f.write(repair.apply(data, json.loads(pathlib.Path(got.plan).read_text())))
        return 0

    from . import api
    from .session import session
    from .sources import arrays

    spark = session()
    if got.command == "recover":
        api.publish(api.recover(spark, got.source, got.dataset), got.output)
        api.verify(spark, got.output).show(1000, False)
    elif got.command == "verify":
        bad = api.verify(spark, got.output).where("not passed")
        bad.show(1000, False)
        return int(not bad.isEmpty())
    elif got.command == "query":
        from .plans import catalogue, further, more  # noqa: F401

        catalogue.QUERIES[got.name](spark, got.tables).show(1000, False)
    else:
        src = arrays.files(spark, got.source)
        {"survey": arrays.datasets, "links": arrays.links, "markers": arrays.markers}[got.command](src).show(1000, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
