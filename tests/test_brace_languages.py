import pytest

from impactgraph.parse import brace_source as B
from impactgraph.parse.blocks import Source
from impactgraph.plans import engine


def by_id(found):
    return {r["unique_id"]: r for r in found[0]}


def test_blocks_skip_comments_and_strings():
    src = Source('a { // }\n "}" /* } */ \'}\' `}`\n}\nb', "script")
    assert len(src.blocks) == 1 and src.line(src.blocks[0].end) == 3
    assert src.block_at(3) == 0 and src.block_at(len(src.text) - 1) == -1
    assert Source("fn f<'a>(x: &'a str) { let c = '}'; }", "rust").blocks[0].end == 36
    assert Source("} {", "go").blocks[0].end == 3
    assert Source("", "java").blocks == []


def test_typescript():
    text = """import axios from 'axios';
import type { A, B as C } from './lib/a';
import * as up from '../up';
const fs = require('fs');
export abstract class Dog<T> extends Animal<T> implements IAnimal, Other {
  private static async load(x: { a: number }): Promise<void> { this.run(); if (x) { helper(x); } }
  run() { return super.run(); }
  #own() {}
  constructor() {}
}
export async function go<T>(x: T) { work(); "fake()"; // no()
}
const arrow = (x: number): void => { inner(); };
export const one = async x => other(x);
function _hidden() {}
"""
    found = B.parse_typescript("src/m.ts", text, "src.m", False)
    got = by_id(found)
    assert set(got) == {"src.m.Dog", "src.m.Dog.load", "src.m.Dog.run", "src.m.Dog.#own", "src.m.go", "src.m.arrow", "src.m.one", "src.m._hidden"}
    assert got["src.m.Dog"]["bases"] == ["Animal", "IAnimal", "Other"] and got["src.m.Dog"]["end_line_no"] == 10
    load = got["src.m.Dog.load"]
    assert (load["visibility"], load["method_kind"], load["async_sync"], load["class_name"]) == ("private", "static", "async", "Dog")
    assert load["calls"] == ["this.run", "helper"] and got["src.m.Dog.run"]["calls"] == ["super.run"]
    assert got["src.m.go"]["calls"] == ["work"] and got["src.m.go"]["async_sync"] == "async"
    assert got["src.m.arrow"]["calls"] == ["inner"] and got["src.m.one"]["calls"] == ["other"] and got["src.m.one"]["async_sync"] == "async"
    assert got["src.m._hidden"]["visibility"] == "private"
    assert dict(found[1]) == {"axios": "axios", "A": "src.lib.a.A", "C": "src.lib.a.B", "up": "up", "fs": "fs"}


def test_javascript_has_no_calls():
    found = B.parse_javascript("a.js", "class Cat extends Animal { f() { g(); } }\nconst fn = () => {}\nfunction init() { x() }\n", "a", False)
    got = by_id(found)
    assert got["a.Cat"]["bases"] == ["Animal"] and set(got) == {"a.Cat", "a.Cat.f", "a.fn", "a.init"}
    assert all(r["calls"] is None for r in got.values())


def test_go():
    text = """package server

import "fmt"
import (
    str "strings"
    "net/http"
)

type Inner struct {
    Val int
}
type Outer struct {
    *Inner
    pkg.Base
    Name string
}
type Handler interface { Handle() error }
func (s *Outer) Handle(w http.ResponseWriter) { fmt.Println(make(w)) }
func (Outer) quiet() {}
func Map[T any](x T) T {
    return x
}
"""
    found = B.parse_go("x/server.go", text, "x.server", False)
    got = by_id(found)
    assert set(got) == {"server.Inner", "server.Outer", "server.Handler", "server.Outer.Handle", "server.Outer.quiet", "server.Map"}
    assert got["server.Outer"]["bases"] == ["Inner", "pkg.Base"] and got["server.Inner"]["bases"] == []
    assert got["server.Outer.Handle"]["calls"] == ["fmt.Println", "make"] and got["server.Outer.quiet"]["visibility"] == "private"
    assert got["server.Map"]["end_line_no"] == 22 and dict(found[1]) == {"fmt": "fmt", "str": "strings", "http": "net/http"}


def test_java():
    text = """package com.example;
import com.example.util.Parser;
import static java.util.List.of;
import java.io.*;
public class Dog extends Animal<String> implements IAnimal, Other<A, B> {
    @Override
    public static Map<String, List<X>> format(String s) { return Parser.parse(s); }
    protected abstract void help();
    class Inner { private int[] get() { return new int[0]; } }
    void run() { super.process(); if (x) { while (y) { go(); } } }
}
"""
    found = B.parse_java("com/example/Dog.java", text, "com.example.Dog", False)
    got = by_id(found)
    assert set(got) == {"com.example.Dog", "com.example.Dog.format", "com.example.Dog.help", "com.example.Dog.Inner", "com.example.Inner.get", "com.example.Dog.run"}
    assert got["com.example.Dog"]["bases"] == ["Animal", "IAnimal", "Other"]
    assert got["com.example.Dog.format"]["method_kind"] == "static" and got["com.example.Dog.format"]["calls"] == ["Parser.parse"]
    assert (got["com.example.Dog.help"]["method_kind"], got["com.example.Dog.help"]["visibility"]) == ("abstract", "private")
    assert got["com.example.Dog.run"]["calls"] == ["super.process", "go"]
    assert dict(found[1]) == {"Parser": "com.example.util.Parser", "of": "java.util.List.of"}


def test_rust():
    text = """use std::collections::HashMap;
use crate::io::{Read, Write as W};
use a::b as c;
pub struct Server { port: u16 }
enum Kind { A }
pub trait Handler { fn handle(&self); }
impl<'a, T> Handler for Server {
    pub async fn listen(&self) { fn nested() {} }
    fn quiet(&self) {}
}
pub fn process<T>(x: T) {}
fn helper() {}
"""
    found = B.parse_rust("lib.rs", text, "lib", False)
    got = by_id(found)
    assert set(got) == {"lib.Server", "lib.Kind", "lib.Handler", "lib.Server.listen", "lib.Server.quiet", "lib.process", "lib.helper"}
    assert got["lib.Server.listen"]["async_sync"] == "async" and got["lib.Server.listen"]["kind"] == "method"
    assert got["lib.process"]["visibility"] == "public" and got["lib.helper"]["visibility"] == "private"
    assert dict(found[1]) == {"HashMap": "std::collections::HashMap", "Read": "crate::io::Read", "W": "crate::io::Write", "c": "a::b"}


@pytest.mark.parametrize("parse", [B.parse_typescript, B.parse_javascript, B.parse_go, B.parse_java, B.parse_rust])
@pytest.mark.parametrize("text", ["", "}}}", "{{{", "class", "func (", "'", '"', "`", "/*"])
def test_broken_files_do_not_fail(parse, text):
    assert isinstance(parse("a.x", text, "a", False)[0], list)


def test_calls_cross_classes_in_the_graph(spark, tmp_path):
    (tmp_path / "sub.ts").write_text("class BaseClass {\n    public baseMethod() {}\n}\n\nclass SubClass extends BaseClass {\n    public run() {\n        this.baseMethod();\n    }\n}\n")
    (tmp_path / "Child.java").write_text("package com.example;\n\nclass Parent {\n    void process() {}\n}\n\nclass Child extends Parent {\n    void run() {\n        super.process();\n    }\n}\n")
    index = engine.index_repository(spark, str(tmp_path))
    nodes, edges = engine.build_graph(index)
    got = {(r.src, r.dst): (r.certainty, r.inheritance) for r in edges.where("relation = 'CALLS'").collect()}
    assert got["sub.SubClass.run", "sub.BaseClass.baseMethod"] == (0.95, True)
    assert got["com.example.Child.run", "com.example.Parent.process"] == (0.95, True)
    ids = {r.id for r in nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in edges.collect())
