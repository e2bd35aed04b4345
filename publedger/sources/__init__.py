"""Readers, writers and the bindings from raw tables to domain tables."""
