"""Requests as dictionaries, answers as dictionaries: the functions behind a service."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import METHODS, Config
from .operators.summary import count_summary, time_summary
from .operators.windows import min_intervals, validation_metrics
from .plans.pipeline import DETECTORS, Pipeline, detect
from .sources import normalize

MEASUREMENT = "epoch double, rtt_value double, source string, destination string"


def _samples(spark: SparkSession, data: dict) -> DataFrame:
    rows = [(float(m["epoch"]), float(m["rtt_value"]), m.get("source"), m.get("destination")) for m in data["measurements"]]
    return normalize(spark.createDataFrame(rows, MEASUREMENT), mode="strict")


def _settings(request: dict) -> Config:
    c = Config().merged(request.get("config") or {})
    changes = {k: request[k] for k in ("algorithm", "threshold", "min_time_elapsed") if request.get(k) is not None}
    c = c.merged({"change_point_detection": changes})
    return c.merged({"jitter_analysis": {"method": request["method"]}}) if request.get("method") is not None else c


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


_recent: deque[float] = deque(maxlen=100)
_counts = {"requests": 0, "errors": 0}


def _guarded(f):
    def run(spark: SparkSession, request: dict) -> dict:
        began = time.time()
        _counts["requests"] += 1
        try:
            out = {"success": True, **f(spark, request), "seconds": time.time() - began}
            _recent.append(out["seconds"])
            return out
        except (KeyError, TypeError, ValueError) as e:
            _counts["errors"] += 1
            _recent.append(time.time() - began)
            return {"success": False, "error": f"{type(e).__name__}: {e}", "seconds": time.time() - began}

    return run


@_guarded
def analyze(spark: SparkSession, request: dict) -> dict:
    """Inferences, change points and summaries of the measurements of a request."""
    r = Pipeline(spark, _settings(request)).run(_samples(spark, request["data"]))
    inf = r.inferences.cache()
    out = {"inferences": _rows(inf.orderBy("start_epoch")), "change_points": _rows(r.change_points.orderBy("epoch")), "summary": (_rows(time_summary(inf)) or [None])[0], "statistics": (_rows(count_summary(inf)) or [None])[0], "metadata": r.metadata.first().asDict()}
    inf.unpersist()
    return out


@_guarded
def validate(spark: SparkSession, request: dict) -> dict:
    """Quality figures of the measurements of a request."""
    return {"metrics": _rows(validation_metrics(_samples(spark, request["data"])))[0]}


@_guarded
def compare_algorithms(spark: SparkSession, request: dict) -> dict:
    """Change points and seconds of several detectors."""
    c = _settings(request)
    minima = min_intervals(_samples(spark, request["data"]), c.data_processing.minimum_interval_minutes).cache()
    results = {}
    for name in request["algorithms"]:
        began = time.time()
        results[name] = {"change_points": _rows(detect(minima, c.change_point_detection, name).orderBy("epoch")), "seconds": time.time() - began}
    minima.unpersist()
    return {"results": results}


def status() -> dict:
    """Requests and errors of this process, and the mean seconds of the last hundred."""
    return {**_counts, "recent_seconds": sum(_recent) / len(_recent) if _recent else 0.0}


def algorithms() -> list[str]:
    """Names of the detectors."""
    return list(DETECTORS)


def methods() -> list[str]:
    """Names of the jitter methods."""
    return list(METHODS)


def config_template() -> dict:
    """All settings with their defaults."""
    return Config().to_dict()


def health(spark: SparkSession) -> dict:
    """Whether the session runs jobs."""
    return {"status": "healthy" if spark.range(1).agg(F.count("*")).first()[0] == 1 else "unhealthy", "spark": spark.version}


#: Additive points of detectors by stated preference.
PREFERENCES = {
    ("speed", "high"): {"ruptures": 2, "adtk": 2, "rbeast": 1},
    ("uncertainty", "yes"): {"bcp": 3, "rbeast": 1},
    ("noise", "high"): {"torch": 2, "bcp": 1},
    ("series", "many"): {"adtk": 3, "rbeast": 3, "torch": 1},
    ("length", "long"): {"adtk": 2, "rbeast": 2, "ruptures": 1},
}


def recommend(preferences: dict[str, str]) -> list[tuple[str, int]]:
    """Detectors by points for preferences, the best first."""
    points = dict.fromkeys(DETECTORS, 0)
    for k, v in preferences.items():
        for name, n in PREFERENCES.get((k, v), {}).items():
            points[name] += n
    return sorted(points.items(), key=lambda p: (-p[1], p[0]))
