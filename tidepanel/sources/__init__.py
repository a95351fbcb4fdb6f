from tidepanel.sources.panel import (  # noqa: F401
    date_range,
    extract_slice,
    head_sample,
    read_metadata_csv,
    read_panel,
    resolve_scan_path,
)
from tidepanel.sources.fixtures import load_panel, panel_from_lineitem, tags_from_part  # noqa: F401
