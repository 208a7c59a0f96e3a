"""Tables in, fitted models in and out."""
