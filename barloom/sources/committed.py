"""Result sets: versions of named tables below one folder of any Hadoop file system, each committed as a whole.

Tables of a version are written to a folder of their own below data/; the version exists from the moment its manifest gets its name in manifests/, by one
rename. A run that dies before leaves files that no reader looks at. Nothing that is committed is changed later, so readers need no locks.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from barloom.sources.digests import file_digests, folder_digest


class ConflictError(RuntimeError):
    """Somebody else has committed the version meanwhile."""


class ResultSet:
    """Several writers are told apart where a rename never replaces a file, as on HDFS; on other file systems one writer at a time is allowed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the committed versions, in order."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{9}\.json", n))

    def _version(self, version: int | None) -> int:
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise FileNotFoundError(f"{self.root} has no version {'yet' if version is None else version}")
        return have[-1] if version is None else version

    def _write_text(self, text: str, path: str) -> None:
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def commit(self, tables: dict[str, DataFrame], facts: dict[str, Any] | None = None, texts: dict[str, str] | None = None, after: int | None = None, checksums: bool = False) -> int:
        """Writes tables, texts (small files by name) and facts as the next version and returns its number. after: the version that the caller has built
        upon (0: none); if it isn't the last one any more, ConflictError. checksums: also keep a digest of each table's files."""
        if bad := [n for n in (*tables, *(texts or {})) if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", n)]:
            raise ValueError(f"no names for tables or texts: {bad}")
        last = max(self.versions(), default=0)
        if after is not None and after != last:
            raise ConflictError(f"built upon version {after}, but the last one is {last}")
        version, data = last + 1, f"data/{last + 1:09d}-{uuid.uuid4().hex}"
        told: dict[str, Any] = {"version": version, "data": data, "facts": facts or {}, "texts": sorted(texts or {}), "tables": {}}
        for name, df in tables.items():
            at = f"{self.root}/{data}/{name}"
            df.write.parquet(at)
            rows = self.spark.read.schema(df.schema).parquet(at).count()  # of what was written, from the files' footers
            told["tables"][name] = {"rows": rows, "schema": json.loads(df.schema.json()), **({"sha256": folder_digest(file_digests(self.spark, at))} if checksums else {})}
        for name, text in (texts or {}).items():
            self._write_text(text, f"{self.root}/{data}/{name}")
        self._publish(told)
        return version

    def _publish(self, told: dict[str, Any]) -> None:
        temp, name = f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp", f"{self.root}/manifests/{told['version']:09d}.json"
        self._write_text(json.dumps(told, sort_keys=True, default=str), temp)
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(temp), self._path(name)):
            self._fs.delete(self._path(temp), False)
            raise ConflictError(f"version {told['version']} is there already")

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """version, data, facts, texts and tables (rows, schema, sha256 if kept) of a version (default: the last)."""
        return json.loads(self._text(f"{self.root}/manifests/{self._version(version):09d}.json"))

    def _text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def text(self, name: str, version: int | None = None) -> str:
        m = self.manifest(version)
        if name not in m["texts"]:
            raise KeyError(name)
        return self._text(f"{self.root}/{m['data']}/{name}")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read([m], name)

    def history(self, name: str) -> DataFrame:
        """The table's rows of all versions that have it, with the schema of the last of them."""
        return self._read([m for m in map(self.manifest, self.versions()) if name in m["tables"]], name)

    def _read(self, manifests: list[dict[str, Any]], name: str) -> DataFrame:
        if not manifests or name not in manifests[-1]["tables"]:
            raise KeyError(name)
        schema = StructType.fromJson(manifests[-1]["tables"][name]["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{m['data']}/{name}" for m in manifests])

    def damaged(self, version: int | None = None) -> list[str]:
        """Tables of a version whose rows or kept digests are no longer those of the manifest."""
        m = self.manifest(version)
        bad = []
        for name, t in m["tables"].items():
            at = f"{self.root}/{m['data']}/{name}"
            if not self._fs.exists(self._path(at)) or self._read([m], name).count() != t["rows"]:
                bad.append(name)
            elif "sha256" in t and folder_digest(file_digests(self.spark, at)) != t["sha256"]:
                bad.append(name)
        return bad
