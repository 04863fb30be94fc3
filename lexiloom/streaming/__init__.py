"""Resumable batch generation."""
