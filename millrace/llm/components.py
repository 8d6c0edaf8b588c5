"""Connected components, as the library has them.

Defined results: edges that join a node with itself and repeated edges add nothing; no edges give no
rows; edges with a null end are left out.
"""

from __future__ import annotations

from millrace.functions.components import EDGES_PER_FILE, components

__all__ = ["EDGES_PER_FILE", "components"]
