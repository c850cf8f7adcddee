"""Crawling a graph step by step under a policy, and judging what was found."""
