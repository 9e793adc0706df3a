"""PySpark library for judging transcript ends and transcripts assembled from RNA reads.

Sub-packages
------------
``functions``  column expressions (contig names, annotation attributes, sequences)
``sources``    readers and writers for annotation, alignment and table files
``operators``  DataFrame -> DataFrame operators (joins, aggregations, rankings, models)
``plans``      jobs composed from operators, and the query/oracle catalogue
``streaming``  note on which operators also accept streaming DataFrames
"""

__version__ = "0.1.0"
