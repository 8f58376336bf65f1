"""Part of edgeloom."""
