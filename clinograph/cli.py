"""python -m clinograph.cli --config FILE [--diagnostics A B]: runs diagnostics and writes their tables."""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import diagnostics
from .session import ship
from .sources.readers import read_config


def main(args: list[str] | None = None) -> None:
    """Fields and output come from the configuration: fields (name: path), output, diagnostics, settings."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--diagnostics", nargs="*")
    parser.add_argument("--list", action="store_true")
    asked = parser.parse_args(args)
    if asked.list:
        print("\n".join(diagnostics.REGISTRY))
        return
    config = read_config(asked.config)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    fields = {name: spark.read.parquet(path) for name, path in config["fields"].items()}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in config.get("settings", {}).items()}
    for name in asked.diagnostics or config.get("diagnostics") or list(diagnostics.REGISTRY):
        for part, table in diagnostics.run(name, fields, diagnostics.Settings(**values)).items():
            table.write.mode("overwrite").parquet(f"{config['output']}/{name}/{part}")


if __name__ == "__main__":
    main()
