"""Models on streams: scoring, and cross-products that grow with each micro-batch."""
