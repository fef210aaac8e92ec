"""Layered, owned and resolved tables for PySpark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns). What reaches the driver on the way is of bounded size: counts, and
whether a round of links has closed anything.
"""

from layerframe.functions.documents import (
    object_keys,
    overlay_json,
    render_doc,
)
from layerframe.functions.maps import overlay_maps
from layerframe.functions.refs import normalize_ref, owned_by_prefix, strip_prefix
from layerframe.operators.folders import linked_files, resolve_links, resolve_paths
from layerframe.operators.inventory import inventory, inventory_counts, json_keys
from layerframe.operators.keys import pair_rows, repeated_keys, require_known, require_unique
from layerframe.operators.lookup import (
    alias_lookup,
    exists_guard,
    lookup_join,
    mark_active,
    owner_of,
    tag_known,
)
from layerframe.operators.managed import (
    managed_apply,
    managed_remove,
    removable,
    switch_owner,
)
from layerframe.operators.overlay import fill_defaults, overlay_rows
from layerframe.operators.snapshot import capture, dereference
from layerframe.operators.state import active_state
from layerframe.sources.corpus import list_items, load_items
from layerframe.sources.sinks import save_new, save_new_files, save_new_table
from layerframe.sources.states import (
    apply_to_state,
    create_state,
    read_state,
    remove_from_state,
    state_version,
)

__all__ = [
    "active_state",
    "alias_lookup",
    "apply_to_state",
    "capture",
    "create_state",
    "dereference",
    "exists_guard",
    "fill_defaults",
    "inventory",
    "inventory_counts",
    "json_keys",
    "linked_files",
    "list_items",
    "load_items",
    "lookup_join",
    "managed_apply",
    "managed_remove",
    "mark_active",
    "normalize_ref",
    "object_keys",
    "overlay_json",
    "overlay_maps",
    "overlay_rows",
    "owned_by_prefix",
    "owner_of",
    "pair_rows",
    "read_state",
    "removable",
    "remove_from_state",
    "render_doc",
    "repeated_keys",
    "require_known",
    "require_unique",
    "resolve_links",
    "resolve_paths",
    "save_new",
    "save_new_files",
    "save_new_table",
    "state_version",
    "strip_prefix",
    "switch_owner",
    "tag_known",
]
