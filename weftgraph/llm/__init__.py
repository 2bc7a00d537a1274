"""Training-data operators: text, tokens and documents at corpus scale.

Nothing outside this folder imports it; deleting it leaves the build-graph
engine whole.
"""
