from lever.sources.series import load_series, series_table_name, load_machine_tables
from lever.sources.catalog import (site_machine_dim, site_machine_dim_from_map, machines_of_site,
                                   distinct_values, shape_report, feature_catalog)
from lever.sources.fixtures import events_series, lineitem_series, EVENT_TYPES

__all__ = ["load_series", "series_table_name", "load_machine_tables", "site_machine_dim",
           "site_machine_dim_from_map", "machines_of_site", "distinct_values", "shape_report",
           "feature_catalog", "events_series", "lineitem_series", "EVENT_TYPES"]
