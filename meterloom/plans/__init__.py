"""The eight feature packs: from house-days to one row per house."""
