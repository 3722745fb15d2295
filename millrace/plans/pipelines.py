"""Pipelines as data: a specification of nodes, checked, then composed into one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import nodes

#: Node types by the name that a specification uses.
TYPES: dict[str, Callable[..., DataFrame]] = {
    "filter": nodes.filter_node, "map": nodes.map_node, "replace_field": nodes.replace_field, "extract_field": nodes.extract_field,
    "hoist_field": nodes.hoist_field, "flatten": nodes.flatten, "cast": nodes.cast_node, "mask_field": nodes.mask_field,
    "value_to_key": nodes.value_to_key, "header_from": nodes.header_from, "header_to": nodes.header_to, "split": nodes.split,
    "convert_timestamp": nodes.convert_timestamp, "deduplicate": nodes.deduplicate, "if": nodes.if_node, "switch": nodes.switch,
    "multi_output": nodes.multi_output, "regex_router": nodes.regex_router, "timestamp_router": nodes.timestamp_router,
    "repartition": nodes.repartition, "schema_decode": nodes.schema_decode, "schema_filter": nodes.schema_filter, "inspect": nodes.inspect,
}


class Pipeline:
    """``{"nodes": [{"id", "type", "after": [ids], ...arguments}]}``: nodes without ``after`` read the input, several ids merge."""

    def __init__(self, spec: dict):
        self.nodes = {n["id"]: n for n in spec["nodes"]}
        if len(self.nodes) != len(spec["nodes"]):
            raise ValueError("ids repeat")
        for n in spec["nodes"]:
            if n["type"] not in (*TYPES, "merge", "sub_pipeline"):
                raise ValueError(f"unknown type {n['type']}")
            for a in n.get("after", ()):
                if a not in self.nodes:
                    raise ValueError(f"{n['id']} comes after unknown {a}")
        self.order = self._sorted()

    def _sorted(self) -> list[str]:
        out: list[str] = []
        todo = dict(self.nodes)
        while todo:
            ready = [k for k, n in todo.items() if all(a in out for a in n.get("after", ()))]
            if not ready:
                raise ValueError("nodes form a cycle")
            out += ready
            todo = {k: n for k, n in todo.items() if k not in ready}
        return out

    def outputs(self) -> list[str]:
        read = {a for n in self.nodes.values() for a in n.get("after", ())}
        return [k for k in self.order if k not in read]

    def build(self, source: DataFrame) -> dict[str, DataFrame]:
        """The result of every node; Catalyst runs those that are asked for, as one plan each."""
        made: dict[str, DataFrame] = {}
        for k in self.order:
            n = self.nodes[k]
            inputs = [made[a] for a in n.get("after", ())] or [source]
            df = inputs[0]
            for more in inputs[1:]:
                df = df.unionByName(more, allowMissingColumns=True)
            args = {a: v for a, v in n.items() if a not in ("id", "type", "after")}
            if n["type"] == "sub_pipeline":
                inner = Pipeline(args["spec"])
                df = inner.build(df)[args.get("output", inner.outputs()[0])]
            elif n["type"] != "merge":
                df = TYPES[n["type"]](df, **args)
            made[k] = df
        return made

    def run(self, source: DataFrame) -> DataFrame:
        """The only output of a pipeline that has one."""
        [last] = self.outputs()
        return self.build(source)[last]
