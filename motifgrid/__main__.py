"""python -m motifgrid JOB --option value ...: a job of motifgrid.jobs; options are its parameters."""

from __future__ import annotations

import argparse
import inspect

from .jobs import JOBS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motifgrid", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        one = jobs.add_parser(name.replace("_", "-"), help=(job.__doc__ or "").split("\n")[0], description=job.__doc__)
        for p in list(inspect.signature(job).parameters.values())[1:]:
            kind = str(p.annotation)
            options = {"required": True} if p.default is p.empty else {"default": p.default}
            if kind == "Sequence[Sequence[float]]":
                options |= {"action": "append", "nargs": "+", "type": float}
            elif kind.startswith("Sequence"):
                options |= {"nargs": "+", "type": float if "float" in kind else str}
            else:
                options["type"] = {"int": int, "float": float}.get(kind, str)
            if options.get("action") and not p.default:
                options["default"] = None
            one.add_argument(f"--{p.name.replace('_', '-')}", **options)
    return top


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    given = vars(parser().parse_args(args))
    job = JOBS[given.pop("job").replace("-", "_")]
    job(SparkSession.builder.getOrCreate(), **{k: v if v is not None or k in ("vectors", "jaccard_scores") else () for k, v in given.items()})


if __name__ == "__main__":
    main()
