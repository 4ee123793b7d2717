"""Declarative data-quality rules; each rule returns a violations DataFrame."""
