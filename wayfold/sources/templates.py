"""Address templates of countries from a public file (YAML, one entry per country code).

An entry is either a text, which only other entries refer to, or a set of fields with ``address_template`` among them.
"""

from __future__ import annotations


def read_templates(path: str) -> dict[str, str]:
    """Template of each country code that has one. The file is small and is read on the driver."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a template file needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f) or {}
    found = {str(code): e.get("address_template") for code, e in entries.items() if isinstance(e, dict)}
    # the code of Norway is a word for "no" to older readers of the format
    return {("NO" if code == "False" else code): t.rstrip("\n") for code, t in found.items() if isinstance(t, str)}
