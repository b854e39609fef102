"""Cluster detection by the tool of this name, if it is installed: ``python -m strandlake.runner strandlake.runner.antismash ...``."""

from . import command

run_module = command(lambda i, o, p: ["antismash", *(p.split() or ["--minimal", "--taxon", "bacteria", "--skip-sanitisation"]), "--output-dir", o, i], "regions.js")


def show_help() -> None:
    print("parameters: options of antismash; without any, a minimal run over bacteria")
