"""Structured formats: Terraform state, Kubernetes Secrets, Compose and CloudFormation files, JSON leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import paths as P


def structured_format(path: Column, content: Column) -> Column:
    """tfstate, k8s, compose or cloudformation, the first that fits; else null."""
    name = F.lower(P.basename(path))
    return (
        F.when(name.endswith(".tfstate") | name.endswith(".tfstate.backup"), "tfstate")
        .when(content.contains("kind:") & content.contains("Secret") & content.contains("data:"), "k8s")
        .when(name.rlike(r"^(docker-)?compose.*\.ya?ml$"), "compose")
        .when(content.contains("AWSTemplateFormatVersion") | content.contains("AWS::"), "cloudformation")
    )


class _Number(float):
    """A number that keeps how it was written."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


def _no_constant(name: str):
    raise ValueError(name)  # NaN and Infinity aren't JSON


def _walk(text: str, max_depth: int | None) -> Iterator[tuple[str, str, str]]:
    """json_path, parent and value of every leaf, in document order, by a stack of what is left to visit."""
    try:
        top = json.loads(text, parse_float=_Number, parse_int=lambda t: int(t) if len(t) < 4000 else _Number(t), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return
    stack = [(top, "", "", 0)]
    while stack:
        v, path, parent, depth = stack.pop()
        if isinstance(v, dict | list):
            if depth == max_depth:
                yield path, parent, json.dumps(v, ensure_ascii=False, separators=(",", ":"))
            elif isinstance(v, dict):
                stack += [(x, f"{path}.{k}" if path else k, k, depth + 1) for k, x in reversed(v.items())]
            else:
                stack += [(v[i], f"{path}[{i}]", parent, depth + 1) for i in range(len(v) - 1, -1, -1)]
        elif v is not None:
            yield path, parent, v if isinstance(v, str) else v.text if isinstance(v, _Number) else json.dumps(v)


def json_leaves(files: DataFrame, text_col: str = "content", key_col: str = "path", max_depth: int | None = None) -> DataFrame:
    """key_col, json_path (a.b[0]), parent (last key), value of every leaf that isn't null.

    Each document is parsed once and walked once, in one pass without a shuffle, however deep it is. Numbers stand as they
    are written; of a repeated key the last value counts. What lies deeper than max_depth, if given, is one leaf, its JSON
    text. Text that isn't JSON, or is nested too deep to be parsed (thousands of levels), gives no rows, and so does null.
    """
    key = files.schema[key_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, leaves, held = [], [], 0

            def flushed(keys: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in zip(*leaves, strict=True))], [key_col, "json_path", "parent", "value"])

            for i, text in enumerate(b["_text"]):
                for leaf in _walk(text.as_py() or "", max_depth):
                    at.append(i)
                    leaves.append(leaf)
                    held += len(leaf[0]) + len(leaf[2])
                    if held > 8 << 20:
                        yield flushed(b[key_col])
                        at, leaves, held = [], [], 0
            if leaves:
                yield flushed(b[key_col])

    shape = StructType([key, *StructType.fromDDL("json_path string, parent string, value string").fields])
    return files.select(F.col(key_col), F.col(text_col).alias("_text")).mapInArrow(run, shape)


def candidates(leaves: DataFrame) -> DataFrame:
    """Leaves as lines: key=value, or the bare value in an array."""
    return leaves.withColumn("line", F.when(F.col("json_path").endswith("]"), F.col("value")).otherwise(F.concat("parent", F.lit("="), "value")))


def decode_base64(value: Column, least_in: int = 16, least_out: int = 8) -> Column:
    """The text behind a base64 value, else null: proper alphabet and padding, valid UTF-8, long enough."""
    shaped = value.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.octet_length(value) % 4 == 0) & (F.octet_length(value) >= least_in)
    text = F.try_validate_utf8(F.try_to_binary(F.when(shaped, value), F.lit("base64")).cast("string"))
    return F.when(F.octet_length(text) >= least_out, text)


def decode_base64_leaves(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("decoded", decode_base64(F.col("value"))).filter(F.col("decoded").isNotNull())


def tfstate_attributes(files: DataFrame) -> DataFrame:
    """path, ord, line: three candidate lines for each attribute of 8 to 5,000 bytes in resources[].instances[].attributes; one per file and value and form."""
    parsed = files.select("path", F.from_json("content", "struct<resources:array<struct<type:string,instances:array<struct<attributes:map<string,string>>>>>>").alias("s"))
    attributes = parsed.select("path", F.explode("s.resources").alias("r")).select("path", "r.type", F.explode("r.instances").alias("i")).select("path", "type", F.explode("i.attributes").alias("key", "value"))
    sized = attributes.filter(F.octet_length("value").between(8, 5000))
    w = Window.partitionBy("path", "value").orderBy("type", "key")
    first = sized.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    forms = F.array(F.format_string('%s_%s = "%s"', "type", "key", "value"), F.concat("key", F.lit("="), "value"), F.col("value"))
    return first.select("path", "type", "key", "value", F.posexplode(forms).alias("ord", "line"))


def yaml_documents(files: DataFrame) -> DataFrame:
    """path, doc, json: every YAML document as JSON; files that aren't YAML give none. YAML can only be read in Python."""

    def converted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML decoding needs PyYAML on the executors") from e

        class Loader(yaml.SafeLoader):
            """Short forms such as !Ref or !Sub count as what they are applied to."""

        def plain(loader, _, node):
            build = {"scalar": loader.construct_scalar, "sequence": lambda n: loader.construct_sequence(n, True), "mapping": lambda n: loader.construct_mapping(n, True)}
            return build[node.id](node)

        Loader.add_multi_constructor("!", plain)
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, json.dumps(d, default=str)) for i, d in enumerate(yaml.load_all(content, Loader))]
                except yaml.YAMLError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "doc", "json"])

    return files.select("path", "content").mapInPandas(converted, "path string, doc int, json string")


def k8s_secret_values(files: DataFrame) -> DataFrame:
    """path, key, value of the decoded .data entries of Secret documents."""
    docs = yaml_documents(files).select("path", F.from_json("json", "struct<kind:string,data:map<string,string>>").alias("d")).filter("d.kind = 'Secret'")
    return docs.select("path", F.explode("d.data").alias("key", "raw")).select("path", "key", decode_base64(F.trim("raw"), 1, 4).alias("value")).filter("value IS NOT NULL")


def compose_env(files: DataFrame) -> DataFrame:
    """path, line of the services' environment entries, KEY=value."""
    env = yaml_documents(files).select("path", F.explode(F.from_json(F.get_json_object("json", "$.services"), "map<string,struct<environment:string>>")).alias("service", "s")).select("path", F.col("s.environment").alias("e"))
    listed = env.select("path", F.explode(F.from_json("e", "array<string>")).alias("line")).filter("line IS NOT NULL")
    mapped = env.filter(F.col("e").startswith("{")).select("path", F.explode(F.from_json("e", "map<string,string>")).alias("k", "v")).select("path", F.concat("k", F.lit("="), "v").alias("line"))
    return listed.union(mapped)


def compose_env_lines(lines: DataFrame) -> DataFrame:
    """KEY and value of lines that look like environment entries, for files that aren't valid YAML; values of 8 or more bytes."""
    rx = r"""^\s*-?\s*([A-Z][A-Z0-9_]+)\s*[=:]\s*['"]?(.+?)['"]?\s*$"""
    return lines.select("path", "line_number", F.regexp_extract("line", rx, 1).alias("key"), F.regexp_extract("line", rx, 2).alias("value")).filter((F.col("key") != "") & (F.octet_length("value") >= 8))


def cfn_values(files: DataFrame) -> DataFrame:
    """String leaves of a template's resources and its parameters' defaults. Templates are JSON, or else the first document of YAML."""
    is_json = F.try_parse_json("content").isNotNull()
    other = yaml_documents(files.filter(~is_json)).filter("doc = 0").select("path", F.col("json").alias("content"))
    leaves = json_leaves(files.filter(is_json).select("path", "content").union(other))
    return leaves.filter(F.col("json_path").startswith("Resources.") | F.col("json_path").rlike(r"^Parameters\.[^.]+\.Default$"))


def structured_context(content: Column, value: Column) -> tuple[Column, Column]:
    """Line number of a value's first occurrence, and the value cut to 117 characters and ... if longer than 120."""
    at = F.locate(value, content) if isinstance(value, str) else F.call_function("locate", value, content)
    line = F.size(F.split(F.left(content, F.greatest(at - 1, F.lit(0))), "\n"))
    return line, F.when(F.length(value) > 120, F.concat(F.left(value, F.lit(117)), F.lit("..."))).otherwise(value)
