"""fotolake.operators"""
