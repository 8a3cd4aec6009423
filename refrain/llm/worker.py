"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
import types


def kept(owner: str, name: str, make):
    """The worker's object of that name, made by make() when it is first asked for.

    A worker serves one operator after another: what the others kept goes, so that caches do not add
    up. This package's functions are sent by value, hence the store is a module of its own name.
    """
    module = sys.modules.setdefault("_refrain_kept", types.ModuleType("_refrain_kept"))
    store = vars(module).setdefault("store", {})
    for key in [k for k in store if k[0] != owner]:
        del store[key]
    if (owner, name) not in store:
        store[owner, name] = make()
    return store[owner, name]
