"""A small HTTP front on the standard library: uploads, then the same calls as the command line, on the newest upload.

GET  /api/health, /api/demo, /api/campaign/<id>[/download|/manifest|/verify|/preview]
POST /api/ingest (body: the file, ?name=), /api/screen, /api/doctor, /api/propose, /api/explore, /api/tstr, /api/campaign,
     /api/generate, /api/certify
Parameters come in the query string. Bad input gives 400, unknown ids 404.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from attestra.operators import ingest
from attestra.operators.ingest import RareEvent
from attestra.operators.regression import Estimand, certify_dataset
from attestra.plans import bundle, generation, scenario
from attestra.plans.cli import scalar
from attestra.sources.tables import fraud_sample, load, preview, to_csv_text

MOST_BYTES = 256 << 20


class NotFound(LookupError):
    pass


@dataclass
class App:
    """State and routes, without sockets."""

    spark: SparkSession
    folder: Path = field(default_factory=lambda: Path(tempfile.mkdtemp(prefix="attestra-http-")))
    upload: str | None = None
    runs: dict[str, dict] = field(default_factory=dict)

    def _source(self):
        if self.upload is None:
            raise ValueError("nothing uploaded")
        return self.upload

    @staticmethod
    def _rare(q: dict[str, str]) -> RareEvent | None:
        if q.get("mode", "label") == "label" and "value" not in q:
            return None
        return RareEvent(q["label"], q.get("mode", "label"), scalar(q["value"]) if "value" in q else None, float(q.get("percentile", 0.05)), q.get("tail", "upper") == "upper")

    def _run(self, run: str) -> dict:
        if run not in self.runs:
            raise NotFound(run)
        return self.runs[run]

    def get(self, parts: list[str], q: dict[str, str]):
        if parts == ["health"]:
            return {"status": "ok", "spark": self.spark.version}
        if parts == ["demo"]:
            self.upload = str(self.folder / "demo.parquet")
            fraud_sample(self.spark).write.mode("overwrite").parquet(self.upload)
            return {"label": "is_fraud", "rows": 2000}
        if parts[:1] == ["campaign"] and len(parts) in (2, 3):
            run = self._run(parts[1])
            what = parts[2] if len(parts) == 3 else "summary"
            if what == "summary":
                return {k: v for k, v in run.items() if k != "rows"}
            if what == "verify":
                return bundle.verify_bundle(self.spark, run["out_dir"])
            if what == "manifest":
                return json.loads((Path(run["out_dir"]) / "manifest.json").read_text())
            rows = self.spark.read.parquet(run.get("path") or run["best_batch_path"])
            if what == "preview":
                return [r.asDict() for r in preview(rows, int(q.get("n", 20))).collect()]
            if what == "download":
                return to_csv_text(rows)
        raise NotFound("/".join(parts))

    def post(self, parts: list[str], q: dict[str, str], body: bytes):
        label, seed = q.get("label", ""), int(q.get("seed", 42))
        what = parts[0] if len(parts) == 1 else ""
        if what == "ingest":
            name = Path(q.get("name", "upload.csv")).name
            path = self.folder / f"{uuid.uuid4().hex}-{name}"
            path.write_bytes(body)
            self.upload = str(path)
            d = generation.ingest_table(self.spark, self.upload, label, self._rare(q))
            return {"label": d.label, "n_rare": d.n_rare, "n_normal": d.n_normal, "fields": [m.to_dict() for m in d.fields.values()]}
        if what == "doctor":
            df = load(self.spark, self._source())
            return ingest.preflight(df, label or ingest.detect_target(df), self._rare(q))
        if what == "propose":
            d = generation.ingest_table(self.spark, self._source(), label, self._rare(q))
            return scenario.Scenario(label=d.label, columns=[scenario.structural(m) for m in d.fields.values()]).to_dict()
        if what == "screen":
            return generation.screen(self.spark, self._source(), label, self._rare(q), seed)
        if what == "explore":
            return generation.explore_options(self.spark, self._source(), label, self._rare(q), int(q.get("rows", 300)), seed)
        if what == "tstr":
            return generation.evaluate_surrogate(self.spark, self._source(), label, self._rare(q), seed=seed)
        if what == "certify":
            spec = Estimand(q["outcome"], tuple(q["predictors"].split(",")), q.get("family", "ols"), ci_level=float(q.get("ci_level", 0.95)), rule=q.get("rule", "consistent"))
            synth = self.spark.read.parquet(self._run(q["run"])["path"])
            return certify_dataset(load(self.spark, self._source()), synth, spec, q["run"])
        if what in ("campaign", "generate"):
            run = uuid.uuid4().hex[:12]
            out = str(self.folder / run)
            if what == "campaign":
                made = generation.run_campaign(self.spark, self._source(), label, self._rare(q), int(q.get("rows", 300)), int(q.get("passes", 5)), private=q.get("privacy", "none"), seed=seed, out_dir=out)
            else:
                made = generation.generate(self.spark, self._source(), label, self._rare(q), int(q.get("rows", 300)), q.get("intent", "balanced"), seed, q.get("auto", "true") == "true", private=q.get("privacy", "floored"), delta=float(q.get("delta", 0.5)), out_dir=out)
            self.runs[run] = made
            return {"id": run, **{k: v for k, v in made.items() if k != "rows"}}
        raise NotFound("/".join(parts))

    def handle(self, method: str, url: str, body: bytes = b"") -> tuple[int, str, str]:
        """(status, content type, text) of a request."""
        split = urlsplit(url)
        parts = [p for p in split.path.split("/") if p]
        q = {k: v[-1] for k, v in parse_qs(split.query).items()}
        try:
            if not parts:
                return 200, "text/html", "<!doctype html><title>attestra</title><p>See /api/health.</p>"
            if parts[0] != "api":
                raise NotFound(split.path)
            out = self.get(parts[1:], q) if method == "GET" else self.post(parts[1:], q, body)
        except NotFound as e:
            return 404, "application/json", json.dumps({"error": f"not found: {e}"})
        except (ValueError, KeyError, FileNotFoundError) as e:
            return 400, "application/json", json.dumps({"error": str(e)[:500]})
        return (200, "text/csv", out) if isinstance(out, str) else (200, "application/json", json.dumps(out, default=str))


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> None:
    app = App(spark)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, kind, text = (413, "application/json", '{"error": "too large"}') if size > MOST_BYTES else app.handle(method, self.path, self.rfile.read(size))
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

    ThreadingHTTPServer((host, port), Handler).serve_forever()
