"""Graph files from the command line: python -m graphloom.cli convert|snap|edges|reorder [-s] [-w] INPUT OUTPUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.operators import primitives
from graphloom.sources import files

FORMATS = ("adjacency", "binary", "edges", "parquet")


def read(spark: SparkSession, kind: str, path: str, directed: bool, weighted: bool):
    if kind == "edges":
        return files.read_edge_list(spark, path, weighted, directed)
    if kind == "adjacency":
        return files.read_adjacency(spark, path, directed)
    return files.read_binary(spark, path, directed, weighted) if kind == "binary" else files.read_parquet(spark, path, directed)


def write(graph, kind: str, path: str, weighted: bool, by_degree: bool = False) -> None:
    if kind == "adjacency":
        files.write_adjacency(graph, path, weighted, by_degree)
        return
    if by_degree:
        graph = graph.relabelled(primitives.degree_order(graph)).store()
    if kind == "edges":
        files.write_edge_list(graph, path, weighted)
    elif kind == "binary":
        files.write_binary(graph, path, weighted)
    else:
        files.write_parquet(graph, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """convert: any format to any other, by degree if asked; snap: an edge list to adjacency text; edges: a graph to an edge list; reorder: a repeatable shuffle of the ids."""
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("command", choices=("convert", "snap", "edges", "reorder"))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("-s", "--symmetric", action="store_true")
    parser.add_argument("-w", "--weighted", action="store_true")
    parser.add_argument("--from", dest="source", choices=FORMATS, default="adjacency")
    parser.add_argument("--to", dest="target", choices=FORMATS, default="parquet")
    parser.add_argument("--by-degree", action="store_true")
    parser.add_argument("--seed", type=int, default=0)
    own = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    source = "edges" if own.command == "snap" else own.source
    target = {"snap": "adjacency", "edges": "edges", "reorder": source, "convert": own.target}[own.command]
    graph = read(spark, source, own.input, not own.symmetric, own.weighted)
    if own.command == "reorder":
        graph = graph.relabelled(primitives.random_order(graph, own.seed)).store()
    write(graph, target, own.output, own.weighted, own.by_degree)


if __name__ == "__main__":
    main()
