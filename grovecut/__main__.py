"""python -m grovecut --config_file settings.ini [--setting value ...]"""

from pyspark.sql import SparkSession

from . import parse_args, run

if __name__ == "__main__":
    spark = SparkSession.builder.appName("grovecut").getOrCreate()
    for row in run(spark, parse_args()) or ():
        print("\t".join(row))
