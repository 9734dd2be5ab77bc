"""Command line: ``python -m helixframe preprocessing|initialize|append|api``.

Options come from the command line, then from the environment (``HELIXFRAME_<NAME>``), then from a YAML file (``--config``), then from defaults.
"""

from __future__ import annotations

import argparse
import os
import sys
import threading
from pathlib import Path

OPTIONS = {
    "database-config": "database_config.yaml", "reference-genomes": "reference_genomes.json", "lineage-definitions": "", "phylogenetic-tree": "", "input": "", "output": "output",
    "data-directory": "output", "table": "default", "port": "8081",
}


def options(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="helixframe")
    parser.add_argument("--version", "-V", action="store_true")
    parser.add_argument("mode", nargs="?", choices=["preprocessing", "initialize", "append", "api"])
    parser.add_argument("--config")
    for name in OPTIONS:
        parser.add_argument(f"--{name}")
    found = parser.parse_args(argv)
    file = {}
    if found.config:
        import yaml

        file = yaml.safe_load(Path(found.config).read_text()) or {}
    for name, default in OPTIONS.items():
        key = name.replace("-", "_")
        if getattr(found, key) is None:
            setattr(found, key, os.environ.get("HELIXFRAME_" + key.upper(), str(file.get(name, default))))
    return found


def main(argv: list[str]) -> int:
    found = options(argv)
    from helixframe.catalog.database import VERSION, Database, latest_state

    if found.version:
        print("helixframe", VERSION)
        return 0
    if found.mode is None:
        print("helixframe: need 'preprocessing', 'initialize', 'append' or 'api' as the first program argument.", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from helixframe.functions.trees import Tree

    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    if found.mode == "append":
        database = Database(found.data_directory, spark)
        database.append_data_from_file(found.table, found.input)
        database.save_checkpoint(found.data_directory)
        return 0
    if found.mode == "api":
        from helixframe.api.server import Active, serve
        from helixframe.sources.store import Folder

        latest = latest_state(Folder(spark, found.data_directory))
        active, stop = Active(Database(latest.path.path, spark) if latest else None), threading.Event()
        serve(active, int(found.port))
        active.watch(found.data_directory, spark, stop)
        return 0
    lineages = {Path(p).name: Path(p).read_text() for p in found.lineage_definitions.split(",") if p}
    tree = Tree.from_file(found.phylogenetic_tree, Path(found.phylogenetic_tree).read_text()) if found.phylogenetic_tree else None
    texts = Path(found.database_config).read_text(), Path(found.reference_genomes).read_text()
    if found.mode == "initialize":
        database = Database.initialize(*texts, lineages=lineages, tree=tree, spark=spark)
    else:
        database = Database.preprocess(*texts, found.input, lineages=lineages, tree=tree, spark=spark)
    database.save_checkpoint(found.output)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
