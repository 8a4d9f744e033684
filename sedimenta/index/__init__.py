"""Stored indexes: tables of immutable segments under one version pointer."""
