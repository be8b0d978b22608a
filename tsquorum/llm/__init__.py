"""Training-data operators: extraction, filtering, de-duplication, mixing, packing, sharding.

Each operator is a module of its own with a general interface; ``queries`` holds the thin
``opN_<name>`` queries over the driver's tables.
"""
