"""Command line: checks settings and tells what a run would do.

0: fine; 1: no settings given; 2: the settings have errors, or the command isn't known.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from vellumen.plans import steps
from vellumen.sources import config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vellumen", description="Document records on Spark: settings and dry runs.")
    commands = top.add_subparsers(dest="command")
    check = commands.add_parser("config", help="settings").add_subparsers(dest="what").add_parser("check", help="check a settings file")
    check.add_argument("--config", type=Path)
    check.set_defaults(run=check_settings)
    dry = commands.add_parser("dry-run", help="tell what a run would do, as JSON")
    dry.add_argument("--config", type=Path)
    dry.set_defaults(run=tell_run)
    return top


def check_settings(given: argparse.Namespace) -> int:
    if given.config is None:
        print("No config was provided.")
        return 1
    checked = config.check(given.config)
    print(f"Config file: {checked.path}", f"Status: {'OK' if checked.ok else 'FAILED'}", *(f"Warning: {w}" for w in checked.warnings), *(f"Error: {e}" for e in checked.errors), sep="\n")
    return 0 if checked.ok else 2


def tell_run(given: argparse.Namespace) -> int:
    report = config.dry_run(given.config) | {"plan": steps.effects(), "steps": steps.report()}
    print(json.dumps(report, ensure_ascii=False, indent=2))
    return 0 if report["ok"] else 2


def main(words: Sequence[str] | None = None) -> int:
    top = parser()
    given = top.parse_args(words)
    if not hasattr(given, "run"):
        top.print_help()
        return 0
    return given.run(given)


if __name__ == "__main__":
    sys.exit(main())
