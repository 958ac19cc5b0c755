"""python -m mixfield study FILE | fit SPEC OBSERVATIONS DESIGN OUT | compare FIT1 FIT2 EFFECTS1 EFFECTS2 OUT

``study`` fits images: FILE (YAML or JSON) lists them, see mixfield.sources.study; fits and maps go
to its outdir.  ``fit`` takes Parquet tables.  SPEC is YAML or JSON; a copy of it is written
next to the results.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import model
from .spec import ModelSpec


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("mixfield").getOrCreate()
    if args[:1] == ["study"] and len(args) == 2:
        from .sources import study

        for path in study.fit(spark, study.read(args[1]))[1]:
            print(path)
        return 0
    if args[:1] == ["fit"] and len(args) == 5:
        spec = ModelSpec.load(args[1])
        stats = model.statistics(spark.read.parquet(args[2]), spark.read.parquet(args[3]), spec)
        model.fit(stats, spec).write.mode("overwrite").parquet(f"{args[4]}/fit")
        model.results(spark.read.parquet(f"{args[4]}/fit")).write.mode("overwrite").parquet(f"{args[4]}/contrasts")
        spark.createDataFrame([(spec.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args[4]}/spec")
        return 0
    if args[:1] == ["compare"] and len(args) == 6:
        out = model.compare(spark.read.parquet(args[1]), spark.read.parquet(args[2]), int(args[3]), int(args[4]))
        out.write.mode("overwrite").parquet(args[5])
        return 0
    print(__doc__)
    return 2


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
