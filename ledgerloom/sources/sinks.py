"""Sinks: transactions, final rows, run report, entity memory, factor text, profiles."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .tables import transactions


def write_transactions(df: DataFrame, path: str) -> None:
    """CSV with the transaction columns in order."""
    transactions(df).drop("doc_id", "seq").write.mode("overwrite").csv(path, header=True)


def write_final(df: DataFrame, path: str, monthly: bool = True) -> None:
    """CSV of the 64 columns, with the month first and in order if monthly."""
    columns = [F.col(f"`{c}`") for c in R.final_columns()]
    out = df.orderBy("statement_month").select("statement_month", *columns) if monthly else df.select(*columns)
    out.write.mode("overwrite").csv(path, header=True)


def capped(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows by seq (all if negative) and a row with the number left out."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    if most < 0:
        return df, total.select(F.lit(0).cast("long").alias("transactions_omitted_from_report"))
    return df.orderBy("seq").limit(most), total.select(F.greatest(F.lit(0).cast("long"), F.col("n") - most).alias("transactions_omitted_from_report"))


def run_report(df: DataFrame, sections: dict[str, DataFrame], most: int = 500) -> str:
    """A JSON report with sorted keys: one-row sections, and the first transactions. Without a cap use write_report."""
    if most < 0:
        raise ValueError("a report of all transactions is written by Spark: use write_report")
    rows, omitted = capped(df, most)
    out = {name: (lambda r: r.asDict(True) if r else {})(section.first()) for name, section in sections.items()}
    out["transactions"] = [json.loads(r.j) for r in rows.select(F.to_json(F.struct("*")).alias("j")).collect()]
    out["transactions_omitted_from_report"] = omitted.first()[0]
    return json.dumps(out, indent=2, ensure_ascii=False, sort_keys=True, default=str)


def write_report(df: DataFrame, sections: dict[str, DataFrame], path: str, most: int = 500) -> None:
    """The same report as a folder: ``sections`` (one line of JSON) and ``transactions``, which never pass the driver."""
    rows, omitted = capped(df, most)
    whole = omitted
    for name, section in sections.items():
        whole = whole.join(F.broadcast(section.limit(1).select(F.struct("*").alias(name))), F.lit(True), "left")  # one row each
    whole.select(F.to_json(F.struct(*sorted(whole.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/sections")
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(f"{path}/transactions")


def save_memory(memory: DataFrame, path: str, profile_id: str) -> None:
    """Rewrites one profile's part of the memory, and only that."""
    memory.withColumn("profile_id", F.lit(profile_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_id").parquet(path)


def factor_text(prediction: dict) -> str:
    """A prediction's factor lists as text."""
    lines = [f"Risk score: {prediction['risk_score']:.6f}", f"Saving probability: {prediction['saving_probability']:.6f}", f"Risk level: {prediction['risk_level']}"]
    for title, name in (("Top factors", "top_factors"), ("Risk factors", "risk_factors"), ("Healthy factors", "healthy_factors")):
        lines.append(f"{title}:")
        lines += [f"  {k}. {f['feature']}: {f['contribution']:.6f}" for k, f in enumerate(prediction.get(name) or [], 1)] or ["  none"]
    return "\n".join(lines) + "\n"


class ProfileStore:
    """Profiles and the active one in a JSON file of the driver."""

    def __init__(self, path: str):
        self.path = path

    def _load(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                data = json.load(f)
        except (OSError, ValueError):
            data = {}
        return data if isinstance(data, dict) and isinstance(data.get("profiles"), list) else {"profiles": [], "active": None}

    def _save(self, data: dict) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(data, f, indent=2, ensure_ascii=False)

    def all(self) -> list[dict]:
        return self._load()["profiles"]

    def get(self, profile_id: str) -> dict | None:
        return next((p for p in self.all() if p["profile_id"] == profile_id), None)

    def active(self) -> dict | None:
        return self.get(self._load()["active"])

    def create(self, name: str, **fields) -> dict:
        data = self._load()
        profile = {"profile_id": uuid.uuid4().hex, "name": name, **fields}
        data["profiles"].append(profile)
        data["active"] = data["active"] or profile["profile_id"]
        self._save(data)
        return profile

    def update(self, profile_id: str, **fields) -> dict:
        data = self._load()
        for p in data["profiles"]:
            if p["profile_id"] == profile_id:
                p.update(fields)
                self._save(data)
                return p
        raise KeyError(profile_id)

    def delete(self, profile_id: str) -> None:
        data = self._load()
        left = [p for p in data["profiles"] if p["profile_id"] != profile_id]
        if len(left) == len(data["profiles"]):
            raise KeyError(profile_id)
        data["profiles"] = left
        if data["active"] == profile_id:
            data["active"] = left[0]["profile_id"] if left else None
        self._save(data)

    def activate(self, profile_id: str) -> None:
        if self.get(profile_id) is None:
            raise KeyError(profile_id)
        self._save(self._load() | {"active": profile_id})
