"""Writers of results."""

from .writers import columnar, detailed_json, enhanced, json_lines, minimal_json, narrow, nested_json, save, summary_json, time_series_json, wide, with_metadata, xml_lines, yaml_lines

__all__ = ["columnar", "detailed_json", "enhanced", "json_lines", "minimal_json", "narrow", "nested_json", "save", "summary_json", "time_series_json", "wide", "with_metadata", "xml_lines", "yaml_lines"]
