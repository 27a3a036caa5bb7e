"""Retrieval, similarity and keyed-table operators for Apache Spark, DataFrame in and DataFrame out."""
