"""Inputs: the tables, text trees, and a fixture with identifiers at known places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Stored bytes of a table that one task takes; its text is larger by what compression saves.
SPREAD_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt by their hash over at least four tasks a core, and over as many as keep each task small: a file's row groups are few and
    large, and searching a text costs far more than moving it, so a task over a row group would grow with the table.

    The size is the planner's, so nothing is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(4 * cores, -(-size // SPREAD_BYTES)), *df.columns)


def text_tree(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text), one row a file, of a folder tree."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: A clinical header made of a row's number alone; both engines read this SQL. Its parts are (literal or expression).
HEADER = """concat('PATIENT: SMITH, JOHN  MRN: ', CAST(100000 + {id} AS STRING), '  DOB: 0', CAST(1 + {id} % 9 AS STRING), '/1', CAST({id} % 10 AS STRING), '/19', CAST(50 + {id} % 40 AS STRING), chr(10),
 'SSN: ', CAST(100 + {id} % 800 AS STRING), '-', CAST(10 + {id} % 90 AS STRING), '-', CAST(1000 + {id} % 9000 AS STRING), '  Phone: (555) 201-', CAST(1000 + {id} % 9000 AS STRING), '  Fax: 555-303-', CAST(1000 + {id} % 7000 AS STRING), chr(10),
 'Email: john.smith', CAST({id} AS STRING), '@example.org  Seen by Dr. Jane Miller, attending: Carol Jones, on 2023-0', CAST(1 + {id} % 9 AS STRING), '-1', CAST({id} % 10 AS STRING), ' and last Monday, hospital day ', CAST(1 + {id} % 20 AS STRING), '.', chr(10),
 'Address: ', CAST(1 + {id} % 999 AS STRING), ' Oak Street, Springfield, IL ', CAST(10000 + {id} % 80000 AS STRING), '  Name: Mary Brown  wife: Anna White  Age: ', CAST(80 + {id} % 30 AS STRING), chr(10),
 'Member ID: HP', CAST(1000000 + {id} AS STRING), '  Account No: AC', CAST(5000 + {id} AS STRING), '  Driver license no: D', CAST(1000000 + {id} AS STRING), '  Passport: ', CAST(10000000 + {id} AS STRING), '  pacemaker serial no: SN-', CAST(20000 + {id} AS STRING), chr(10),
 'VIN: 1HGCM82633A', CAST(100000 + {id} % 900000 AS STRING), '  plate no: ABC-', CAST(100 + {id} % 900 AS STRING), '  fingerprint id FP', CAST({id} AS STRING), '  IP 10.0.', CAST({id} % 256 AS STRING), '.7  http://www.example.org/p/', CAST({id} AS STRING), chr(10),
 'IPv6 2001:db8:0:0:0:0:0:', CAST({id} % 9999 AS STRING), ' or fe80::', CAST(1 + {id} % 99 AS STRING), '  MAC 00:1B:44:11:3A:', CAST(10 + {id} % 90 AS STRING), '  IBAN DE44500105175407', CAST(10000 + {id} % 80000 AS STRING), '  wallet 1BoatSLRHtKNngkdXEeobR76b53LETtp', CAST(1 + {id} % 9 AS STRING), chr(10),
 'Apt B', CAST(1 + {id} % 99 AS STRING), ', lives in Boston, at 40.71', CAST(10 + {id} % 90 AS STRING), ', -74.00', CAST(10 + {id} % 90 AS STRING), '  ref 123e4567-e89b-12d3-a456-4266141', CAST(10000 + {id} % 80000 AS STRING), '  DNA sample, spoke with Ann Lee  Chart #: ', CAST(20000 + {id} AS STRING), chr(10),
 'PATIENT:', chr(10), 'MARY ANN BROWN', chr(10), 'FILE #:', chr(10), CAST(700000 + {id} AS STRING), chr(10),
 'The patient was diagnosed with hypertension and admitted to the hospital; medication and surgery were discussed. MEDICAL RECORD', chr(10))"""

CLINICAL = f"SELECT doc_id, concat({HEADER.format(id='doc_id')}, text) AS text, doc_id AS id FROM documents WHERE text IS NOT NULL"


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the header before each text: (doc_id, text)."""
    head = F.expr(HEADER.format(id="doc_id"))
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null").select("doc_id", F.concat(head, F.col("text")).alias("text"))
