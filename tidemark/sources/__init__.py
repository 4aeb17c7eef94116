"""Readers: object listings, sentinels, manifests, status markers, archive logs."""
