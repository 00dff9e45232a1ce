"""Command line: compare two source trees."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .config import CompareConfig, load_env_file, with_env


def parser() -> argparse.ArgumentParser:
    d = CompareConfig()
    p = argparse.ArgumentParser(prog="graftwood", description="Find similar code in two source trees.")
    run = p.add_subparsers(dest="command", required=True).add_parser("compare")
    run.add_argument("repo_a")
    run.add_argument("repo_b")
    run.add_argument("--output", "-o")
    run.add_argument("--output-dir", default=d.output_dir)
    run.add_argument("--format", choices=("markdown", "json"), default=d.output_format)
    run.add_argument("--rps", type=float, default=d.rps)
    run.add_argument("--threshold", type=int, default=d.similarity_threshold)
    run.add_argument("--model", default=d.model)
    run.add_argument("--api-key", default=os.environ.get("OPENAI_API_KEY"))
    run.add_argument("--base-url", default=os.environ.get("OPENAI_BASE_URL"))
    run.add_argument("--lang", help="languages or extensions, comma-separated")
    run.add_argument("--shallow", action="store_true", help="stop after the directory matches")
    run.add_argument("--match-batch-size", type=int, default=d.match_batch_size)
    run.add_argument("--max-in-flight", type=int, default=int(os.environ.get("GRAFTWOOD_MAX_IN_FLIGHT", d.max_in_flight)))
    run.add_argument("--json-mode", action="store_true", default=None)
    run.add_argument("--parallel-tool-calls", action="store_true", default=None)
    run.add_argument("--token-ranks", help="ranks file of a public tokenizer, for exact token counts")
    run.add_argument("--offline", action="store_true", help="patterns instead of a model")
    run.add_argument("--verbose", "-v", action="store_true")
    return p


def config_of(args: argparse.Namespace) -> CompareConfig:
    given = frozenset(k for k, v in (("use_json_mode", args.json_mode), ("parallel_tool_calls", args.parallel_tool_calls)) if v)
    languages = frozenset(t.strip() for t in (args.lang or "").split(",") if t.strip())
    config = CompareConfig(
        languages=languages,
        model=args.model,
        base_url=args.base_url,
        api_key=args.api_key,
        rps=args.rps,
        max_in_flight=args.max_in_flight,
        use_json_mode=bool(args.json_mode),
        parallel_tool_calls=bool(args.parallel_tool_calls),
        token_ranks=args.token_ranks,
        match_batch_size=args.match_batch_size,
        shallow=args.shallow,
        similarity_threshold=args.threshold,
        output_dir=args.output_dir,
        output_path=args.output,
        output_format=args.format,
    )
    return with_env(config, load_env_file(), given)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    config = config_of(args)
    from .backends import HttpBackend, OfflineBackend
    from .functions.tokenizers import tokenizer_of
    from .plans.compare import Comparison

    if args.offline:
        make = lambda parts: OfflineBackend(config.similarity_threshold)
    elif config.api_key:
        make = lambda parts: HttpBackend(config.base_url or "https://api.openai.com/v1", config.api_key, config.model, config.rps / parts, config.use_json_mode)
    else:
        print("no API key: give --api-key, set OPENAI_API_KEY, or use --offline", file=sys.stderr)
        return 1
    try:
        # speculation would send requests twice
        session = spark or SparkSession.builder.appName("graftwood").config("spark.speculation", "false").getOrCreate()
        Comparison(session, config, make, tokenizer_of(config.token_ranks)).run(args.repo_a, args.repo_b)
    except Exception as e:
        logging.error("%s", e, exc_info=args.verbose)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
