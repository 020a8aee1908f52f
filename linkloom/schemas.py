"""Schemas of the tables this package reads and writes.

A registry is kept as two tables, because the list of files that cite one URL
has no bound: `references` has one row per URL, `cited_in` one row per URL
and file.  `linkloom.operators.registry.nested` brings them together again.
"""

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    names = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
             "date": T.DateType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, names[t]) for n, t in (part.split(":") for part in ddl.split())])


MARKDOWN = _struct("path:string content:string")
CRAWL = _struct("url:string final_url:string title:string html:string error:string attempt:int")
TEXTDOCS = _struct("path:string text:string error:string")
REFERENCES = _struct(
    "url:string title:string categories:strings status:string verified:timestamp notes:string"
)
CITED_IN = _struct("url:string path:string arg_no:int scan:int")
META = _struct(
    "version:int created:date last_verified:timestamp tool:string total_links:bigint"
)
