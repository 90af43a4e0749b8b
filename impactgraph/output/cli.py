"""Command line: index, analyze, diff and serve."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from ..plans.service import Service
from ..sources import diff_text
from ..sources.settings import Settings
from . import render, requests


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="impactgraph")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, told: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=told)
        sub.add_argument("--repo", "-r", default=".")
        sub.add_argument("--framework", "-f")
        sub.add_argument("--index-dir")
        sub.add_argument("--diagnostics", "-d", action="store_true")
        return sub

    command("index", "index a repository")
    analyze = command("analyze", "tests that a change of a symbol can reach")
    analyze.add_argument("target")
    analyze.add_argument("--no-chains", action="store_true")
    diff = command("diff", "tests that the changes of a working tree can reach")
    diff.add_argument("--base")
    diff.add_argument("--staged", action="store_true")
    for sub in (analyze, diff):
        sub.add_argument("--format", choices=["terminal", "json", "markdown"])
        sub.add_argument("--max-depth", type=int)
        sub.add_argument("--threshold", type=int)
        sub.add_argument("--strict", action="store_true", default=None)
    command("serve", "answer JSON requests on standard input")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code: 1 for more tests than a strict threshold, or a diff that git cannot give; else 0."""
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("impactgraph").getOrCreate()
    settings = Settings(args.repo)
    service = Service(spark, args.index_dir or settings.value("general", "index_dir", "") or None)
    framework = args.framework or settings.value("general", "framework", "") or None
    code = 0
    if args.command == "index":
        print(json.dumps(service.index_repository(args.repo, framework)))
    elif args.command == "serve":
        os.environ.setdefault("IMPACTGRAPH_REPO", os.path.realpath(args.repo))
        requests.serve(service, sys.stdin, sys.stdout)
    else:
        code = _report(args, settings, service, framework)
    if args.diagnostics:
        print(json.dumps(service.metrics), file=sys.stderr)
    return code


def _report(args: argparse.Namespace, settings: Settings, service: Service, framework: str | None) -> int:
    depth = args.max_depth if args.max_depth is not None else settings.value("general", "max_depth", 10)
    if args.command == "analyze":
        target, hits = args.target, service.hits(args.repo, args.target, framework, depth)
    else:
        try:
            text = diff_text.git_diff(service.spark, args.repo, args.staged, args.base or "HEAD").first().text
        except (subprocess.CalledProcessError, OSError) as e:
            print(f"git diff failed: {e}", file=sys.stderr)
            return 1
        changed, hits = service.diff_hits(args.repo, text, framework, depth)
        if not changed:
            print("No modified symbols found in the git diff.")
            return 0
        target = ", ".join(changed)
    kind = args.format or settings.value("general", "format", "terminal")
    if kind == "json":
        print(render.as_json(hits))
    elif kind == "markdown":
        print(render.as_markdown(hits, target))
    else:
        print(render.as_text(hits, target, not getattr(args, "no_chains", False)))
    threshold = args.threshold if args.threshold is not None else settings.value("general", "threshold", 0)
    strict = args.strict if args.strict is not None else settings.value("general", "strict", False)
    if threshold > 0 and len(hits) > threshold:
        print(f"Warning: affected tests ({len(hits)}) exceed the threshold ({threshold}).", file=sys.stderr)
        return 1 if strict else 0
    return 0
