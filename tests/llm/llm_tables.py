SF = "/root/testdata/sf0.001"


def rows_of(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]
