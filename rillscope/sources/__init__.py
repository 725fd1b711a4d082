"""Readers that turn files and frames into samples."""

from .influx import influx_lines, read_influx
from .readers import SCAMPER, concat_frames, infer_format, normalize, read_csv, read_expected, read_path, read_scamper, scamper_samples

__all__ = ["SCAMPER", "concat_frames", "infer_format", "influx_lines", "normalize", "read_csv", "read_expected", "read_influx", "read_path", "read_scamper", "scamper_samples"]
